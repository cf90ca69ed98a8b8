"""Suffix-array dedup: removes every byte covered by a long string that starts anywhere else.

A string of WIDTH bytes must be judged against the whole corpus, so the work
is dealt by content. Every window of WIDTH bytes elects an anchor, its
GRAM-byte string of the smallest hash; equal windows elect equal anchors.
Anchors that are elected at one place only are dropped. For the others the
text under the windows they stand for goes to the task of that anchor, where

1. neighbours in sorted order give the furthest that each text can agree with
   any other to the left and to the right, which trims it;
2. equal trimmed texts become one, with its number of copies;
3. the suffix array of the distinct texts (linear grouping, lyndon.py) decides
   which windows occur twice.

Texts of more than one copy are repeated as a whole, and still stand in the
suffix array as partners of the others. Anchors of very many contexts are cut
to what occurs twice by counting window hashes first (_hot_spans), so that
only distinct repeated texts meet in a task.

Defined cases: null text is empty; documents shorter than WIDTH keep all;
repeated rows count as other places, so each loses what both hold; null and
repeated ids are allowed (a row is known by two 64-bit hashes, of its id and of its text); an empty table
gives an empty result; characters cut in two are dropped from the decoded
text, not from the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, dropped, mapped, slices, staged
from .lyndon import repeated_windows

GRAM = 64
#: Elections of one anchor beyond which its contexts are sieved before they meet in one task (of about 60 MB here).
HOT = 100_000
#: Repeated anchors that are sent to every task as one sorted array of 8 bytes each; beyond it they are joined.
BROADCAST_ANCHORS = 1_000_000
_P = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))
_HASH_BITS = ~U64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes of data, by doubling from words of eight bytes."""
    h = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    h ^= h >> U64(29)
    h *= _P[0]
    step = 8
    for p in _P:
        h = (h[:-step] ^ (h[:-step] >> U64(32))) * p + h[step:]
        step *= 2
    h ^= h >> U64(31)
    h *= _P[1]
    return h


def _anchors(blob: bytes, offsets: np.ndarray, width: int):
    """Arrays (document, anchor hash, anchor, first window, last window) over documents laid end to end.

    offsets: where each document starts, and the end. Positions are in the blob; windows are named by their starts.
    """
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    data = np.frombuffer(blob, np.uint8)
    if len(data) < width:
        return none
    h = _gram_hashes(data)
    if len(h) >= 1 << 24:
        raise ValueError("a slice must be shorter than 16 MiB")
    best = (h & _HASH_BITS) | np.arange(len(h), dtype=U64)
    reach, span = width - GRAM + 1, 1
    while span * 2 <= reach:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < reach:
        best = np.minimum(best[: len(best) - (reach - span)], best[reach - span :])
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(best)]
    starts = np.arange(len(best))
    good = np.flatnonzero(starts + width <= offsets[1:][owner])
    if not len(good):
        return none
    at = (best[good] & ~_HASH_BITS).astype(np.int64)
    doc = owner[good]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(good)] - 1
    return doc[first], h[at[first]].astype(np.int64), at[first], good[first], good[last]


def _pieces(texts: list[bytes], width: int, whole: int = 4 << 20):
    """Slices of a batch: (first document, blob, anchors). A document over a slice's limit is cut with an overlap."""
    for part in slices(np.array([len(t) for t in texts]), 1 << 20):
        group = texts[part]
        if len(group) == 1 and len(group[0]) > whole:
            for i in range(0, len(group[0]), whole):
                blob = group[0][i : i + whole + width - 1]
                yield part.start, i, blob, _anchors(blob, np.array([0, len(blob)]), width)
        else:
            blob = b"".join(group)
            yield part.start, 0, blob, _anchors(blob, np.r_[0, np.cumsum([len(t) for t in group])], width)


def _bytes(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def repeated_anchors(rows: DataFrame, width: int) -> DataFrame:
    """anchor, n: anchors elected in two places or more, over all rows, and how often."""

    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [a[1] for _, _, _, a in _pieces(_bytes(pdf["text"]), width)]
        keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pd.DataFrame({"anchor": keys, "n": n})

    return mapped(rows.select("text"), batch, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where h is in the sorted array known."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _objects(values: list) -> pd.Series:
    """A column of arrays or bytes, typed alike when it is empty."""
    return pd.Series(values, dtype=object)


CONTEXT = "anchor long, head int, windows int, body binary, who array<long>, row array<long>, start array<long>"


def _contexts(rows: DataFrame, width: int, known: np.ndarray | None) -> DataFrame:
    """Contexts of the elections of an anchor in `known` (None: all), equal ones of a batch as one row.

    body: the bytes under its windows; head: bytes before the anchor; who, row, start: the documents, and
    where in each the first window stands.
    """

    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = _bytes(pdf["text"])
        who, row = pdf["who"].to_numpy(), pdf["row"].to_numpy()
        found: dict[tuple, list[tuple[int, int]]] = {}
        for base, moved, blob, (doc, h, at, lo, hi) in _pieces(texts, width):
            if known is not None:
                keep = np.flatnonzero(_among(h, known))
                doc, h, at, lo, hi = (x[keep] for x in (doc, h, at, lo, hi))
            if not len(doc):
                continue
            origin = np.cumsum([0, *map(len, texts[base : base + int(doc.max()) + 1])])[:-1] if not moved else np.array([0])
            for key, own, start in zip(zip(h.tolist(), (at - lo).tolist(), (hi - lo + 1).tolist(), [blob[i:j] for i, j in zip(lo.tolist(), (hi + width).tolist(), strict=True)], strict=True), (doc + base).tolist(), (lo - origin[doc] + moved).tolist(), strict=True):
                found.setdefault(key, []).append((own, start))
        keys, refs = list(found), [np.array(x, np.int64) for x in found.values()]
        return pd.DataFrame({
            "anchor": [k[0] for k in keys], "head": [k[1] for k in keys], "windows": [k[2] for k in keys], "body": _objects([k[3] for k in keys]),
            "who": _objects([who[x[:, 0]] for x in refs]), "row": _objects([row[x[:, 0]] for x in refs]), "start": _objects([x[:, 1] for x in refs]),
        })

    return mapped(rows.select("who", "row", "text"), batch, CONTEXT)


def _furthest(group: np.ndarray, sides: list[bytes]) -> np.ndarray:
    """How many first bytes each text has in common with the nearest other text of its group."""
    longest = max(map(len, sides), default=0)
    n = len(sides)
    out = np.zeros(n, np.int64)
    if n < 2 or not longest:
        return out
    sizes = np.fromiter(map(len, sides), np.int64, n)
    order = np.array(sorted(range(n), key=lambda i: (group[i], sides[i])))
    for part in range(0, n - 1, 20_000):
        seats = order[part : part + 20_001]
        table = np.frombuffer(b"".join([sides[i].ljust(longest, b"\0") for i in seats]), np.uint8).reshape(len(seats), longest)
        differ = table[1:] != table[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
        common = np.minimum(common, np.minimum(sizes[seats[1:]], sizes[seats[:-1]]))
        common[group[seats[1:]] != group[seats[:-1]]] = 0
        np.maximum.at(out, seats[1:], common)
        np.maximum.at(out, seats[:-1], common)
    return out


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """Consecutive integers as (first, last)."""
    out: list[tuple[int, int]] = []
    for p in places:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def repeated_spans(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Whole groups of contexts -> (who, row, lo, hi), the bytes covered by windows that occur twice."""
    group = pdf["anchor"].to_numpy()
    body, head, wins = pdf["body"].tolist(), pdf["head"].to_numpy().astype(np.int64), pdf["windows"].to_numpy().astype(np.int64)
    copies = pdf["start"].map(len).to_numpy()
    right = _furthest(group, [b[h : h + width] for b, h in zip(body, head, strict=True)])
    left = _furthest(group, [b[:h][::-1] for b, h in zip(body, head, strict=True)])
    first = np.where(copies > 1, 0, np.maximum(0, head - left))
    last = np.where(copies > 1, wins - 1, np.minimum(wins - 1, head + right - width))
    texts: dict[int, dict[bytes, list[int]]] = {}
    for i in np.flatnonzero(first <= last).tolist():
        texts.setdefault(group[i], {}).setdefault(body[i][first[i] : last[i] + width], []).append(i)
    rows: list[int] = []
    lo: list[int] = []
    hi: list[int] = []
    for classes in texts.values():
        strings = list(classes)
        twice = [len(x) > 1 or copies[x[0]] > 1 for x in classes.values()]
        windows = repeated_windows(strings, width) if not all(twice) and len(strings) > 1 else [[]] * len(strings)
        for s, found, whole in zip(strings, windows, twice, strict=True):
            runs = [(0, len(s) - width)] if whole else _runs(found)
            for i in classes[s]:
                for a, b in runs:
                    rows.append(i)
                    lo.append(first[i] + a)
                    hi.append(first[i] + b + width)
    n = copies[rows] if rows else np.empty(0, np.int64)
    who, row, start = (np.concatenate([np.empty(0, np.int64), *[own[i] for i in rows]]) for own in (pdf["who"].tolist(), pdf["row"].tolist(), pdf["start"].tolist()))
    return pd.DataFrame({"who": who, "row": row, "lo": start + np.repeat(np.array(lo, np.int64), n), "hi": start + np.repeat(np.array(hi, np.int64), n)})


def _spans(contexts: DataFrame, width: int) -> DataFrame:
    """Contexts dealt and sorted by anchor, whole groups of them judged together."""

    def run(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf["anchor"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
            if cut:
                yield repeated_spans(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True), width)
                held = [pdf.iloc[cut:]]
            elif held and held[-1]["anchor"].iloc[-1] != keys[0]:
                yield repeated_spans(pd.concat(held, ignore_index=True), width)
                held = [pdf]
            else:
                held.append(pdf)
        if held:
            yield repeated_spans(pd.concat(held, ignore_index=True), width)

    dealt = contexts.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return dealt.mapInPandas(run, "who long, row long, lo long, hi long")


def _named(df: DataFrame, a: str, b: str, *columns: str) -> DataFrame:
    """df with two 64-bit hashes of the columns."""
    return df.withColumn(a, F.xxhash64(*columns)).withColumn(b, F.xxhash64(F.lit(31), *columns))


def _hot_spans(contexts: DataFrame, width: int) -> DataFrame:
    """As _spans, for anchors of any number of contexts: no task holds the contexts of an anchor.

    Equal contexts become one by aggregation. Each window's hash is counted over all contexts (combined before
    the shuffle), and contexts are cut to the runs of windows that occur twice. What remains are few distinct
    texts with their numbers; the suffix arrays are built on those, and their answer is joined back.
    """
    named = _named(contexts, "c1", "c2", "anchor", "head", "windows", "body")
    places = staged(named.select("c1", "c2", F.arrays_zip("who", "row", "start").alias("places")), "hot-places")
    single = named.groupBy("c1", "c2").agg(*[F.first(c).alias(c) for c in ("anchor", "head", "windows", "body")], F.sum(F.size("start")).alias("n"))
    single = staged(single, "hot-contexts")

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        from xxhash import xxh3_64_intdigest

        each = pdf["windows"].to_numpy()
        at = np.concatenate([np.empty(0, np.int64), *map(np.arange, each)])
        hashes = np.array([xxh3_64_intdigest(b[i : i + width]) for b, w in zip(pdf["body"], each, strict=True) for i in range(w)], U64).astype(np.int64)
        return pd.DataFrame({"c1": np.repeat(pdf["c1"].to_numpy(), each), "c2": np.repeat(pdf["c2"].to_numpy(), each), "at": at, "h": hashes, "n": np.repeat(pdf["n"].to_numpy(), each)})

    every = mapped(single.select("c1", "c2", "windows", "body", "n"), windows, "c1 long, c2 long, at int, h long, n long")
    twice = every.groupBy("h").agg(F.sum("n").alias("all")).where("all > 1").select("h")
    kept = every.join(twice, "h").groupBy("c1", "c2").agg(F.sort_array(F.collect_list("at")).alias("ats"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(c1, c2, n, anchor, head - a, b - a + 1, body[a : b + width], a) for c1, c2, n, anchor, head, body, ats in zip(*(pdf[c] for c in ("c1", "c2", "n", "anchor", "head", "body", "ats")), strict=True) for a, b in _runs(list(ats))]
        return pd.DataFrame(rows, columns=["c1", "c2", "n", "anchor", "head", "windows", "body", "shift"])

    runs = mapped(single.join(kept, ["c1", "c2"]).select("c1", "c2", "n", "anchor", "head", "body", "ats"), cut, "c1 long, c2 long, n long, anchor long, head int, windows int, body binary, shift int")
    runs = staged(_named(runs, "t1", "t2", "anchor", "head", "body"), "hot-runs")
    texts = runs.groupBy("t1", "t2").agg(*[F.first(c).alias(c) for c in ("anchor", "head", "windows", "body")], F.sum("n").alias("n"))
    # A text of several copies names itself twice, which is all that the groups ask.
    twofold = lambda c: F.when(F.col("n") > 1, F.array(c, c)).otherwise(F.array(c))
    found = _spans(texts.select("anchor", "head", "windows", "body", twofold(F.col("t1")).alias("who"), twofold(F.col("t2")).alias("row"), twofold(F.lit(0).cast("long")).alias("start")), width)
    found = found.distinct().select(F.col("who").alias("t1"), F.col("row").alias("t2"), "lo", "hi")
    back = runs.select("t1", "t2", "c1", "c2", "shift").join(found, ["t1", "t2"]).join(places, ["c1", "c2"])
    # Places stay in arrays, one for each batch, until the joins are done.
    back = back.select("shift", "lo", "hi", F.explode("places").alias("p")).select("shift", "lo", "hi", "p.who", "p.row", "p.start")
    return back.select("who", "row", (F.col("start") + F.col("shift") + F.col("lo")).alias("lo"), (F.col("start") + F.col("shift") + F.col("hi")).alias("hi"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def substring_dedup(docs: DataFrame, width: int = 400, key: str = "doc_id", text: str = "text", broadcast: int = BROADCAST_ANCHORS, hot: int = HOT, decoded: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the kept bytes (`kept`), n_bytes, n_removed and the removed spans for every row of docs.

    decoded: kept is text (null for null), without the characters that a cut left incomplete; n_removed still
    counts bytes. carry: further columns that go along, which saves a join.
    """
    kinds = dict(docs.dtypes)
    # Columns that only go along travel as text, so that nulls do not turn integers into floats.
    along = {f"_{i}": c for i, c in enumerate((key, *carry))}
    rows = docs.select(*[F.col(c).cast("string").alias(a) for a, c in along.items()], F.xxhash64(F.col(key), F.lit(29)).alias("who"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    anchors = staged(repeated_anchors(rows, width), "anchors")

    def judged(some: DataFrame, how) -> DataFrame:
        if some.count() <= broadcast:
            known = np.sort(some.select("anchor").toPandas()["anchor"].to_numpy(dtype=np.int64))
            return how(_contexts(rows, width, known), width)
        return how(_contexts(rows, width, None).join(some.select("anchor"), "anchor"), width)

    spans = judged(anchors.where(F.col("n") <= hot), _spans)
    crowded = anchors.where(F.col("n") > hot)
    if not crowded.isEmpty():
        spans = spans.union(judged(crowded, _hot_spans))
    spans = staged(spans.distinct(), "spans")
    dropped(anchors)
    found = spans.groupBy("who", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    both = rows.join(found, ["who", "row"], "left").select(*along, "text", "spans")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, removed, counts, lost = [], [], [], []
        for text_, data, spans in zip(pdf["text"], _bytes(pdf["text"]), pdf["spans"], strict=True):
            gone = _merged((s["lo"], s["hi"]) for s in spans) if spans is not None else []
            parts, at = [], 0
            for lo, hi in gone:
                parts.append(data[at:lo])
                at = hi
            parts.append(data[at:])
            rest = b"".join(parts)
            kept.append(rest if not decoded else None if text_ is None else rest.decode("utf-8", "ignore"))
            removed.append([{"lo": lo, "hi": hi} for lo, hi in gone])
            counts.append(len(data))
            lost.append(sum(hi - lo for lo, hi in gone))
        return pd.DataFrame({**{a: pdf[a] for a in along}, "n_bytes": counts, "n_removed": lost, "kept": kept, "removed": removed})

    schema = ", ".join(f"{a} string" for a in along) + f", n_bytes long, n_removed long, kept {'string' if decoded else 'binary'}, removed array<struct<lo: long, hi: long>>"
    out = mapped(both, cut, schema)
    return out.select(*[F.col(a).cast(kinds[c]).alias(c) for a, c in along.items()], "n_bytes", "n_removed", "kept", "removed")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
