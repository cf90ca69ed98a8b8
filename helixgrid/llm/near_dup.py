"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles becomes a signature of SLOTS symbols of
eight bits (the low byte of a minimum hash each). Two signatures are compared
by the number of symbols that differ. The signature is split into
CHUNKS = SLOTS / WIDTH chunks; within a chunk one differing symbol is allowed,
which is enumerated by leaving out each symbol in turn. By the pigeonhole
principle every pair that differs in at most 2 * CHUNKS - 1 symbols agrees on
one of these keys, so none is missed. With 100 slots in chunks of five the
bound is 39. At a similarity of exactly 0.8, 20 symbols differ on average, and
over 39 with a probability of 3e-6; pairs above 0.8 are safer still.
Every candidate is confirmed on its full sets.

Within a bucket not all pairs are made: each member is first tried against the
bucket's busiest member (the one that meets most others in all its buckets,
which the original of many copies does). Confirmed links are contracted to components, and
only members of one bucket that are still in different components are compared
with each other, in blocks of bounded size; what passes the signature bound and an
upper bound of the intersection (counts of shingles in hashed parts) is
confirmed on full sets again. Components, not links, are the result, so pairs
already connected need no test and no link between different texts is lost.

Defined cases: documents without a shingle (null, empty, white space) are
their own component; equal sets are linked through their class before any
search. Rows are compared as rows (a hash of id and text), so each of several texts under
one id, or without an id, has its own verdict. A component has the smallest id
of its rows, null if no row has one; the row of that id stays (of several, the
one of the smallest hash; equal rows get equal answers). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, dropped, mapped, mapped_slices, mix64, row_key, split_words, staged
from .components import connected_components

SLOTS, WIDTH = 100, 5
CHUNKS = SLOTS // WIDTH
BOUND = 2 * CHUNKS - 1
KEY_BITS = 8 * (WIDTH - 1)
SPREAD = 256
#: Members of a bucket that one task compares with as many others.
BLOCK = 2000
#: Bits, as a power of two, of the table that keeps texts nobody asks for out of a shuffle: at most 2**(SIEVE - 6) rows of 64 bits are broadcast.
SIEVE = 26

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 2**63, SLOTS, dtype=np.uint64) << U64(1)) | U64(1)
_B = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a sequence of word hashes; fewer words than size: one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, U64)
    size = min(size, n)
    h = words[: n - size + 1].copy()
    for j in range(1, size):
        h = mix64(h) + words[j : n - size + 1 + j]
    return np.unique(mix64(h + U64(size)))


def signature(shingles: np.ndarray) -> bytes:
    """The low byte of each slot's minimum; slots are multiply-add permutations of the mixed hashes."""
    out = np.full(SLOTS, np.iinfo(np.uint64).max, U64)
    step = max(1, 20_000 // SLOTS * 8)
    for i in range(0, len(shingles), step):
        np.minimum(out, (shingles[i : i + step, None] * _A[None, :] + _B[None, :]).min(axis=0), out=out)
    return (mix64(out) >> U64(56)).astype(np.uint8).tobytes()


def spread(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of SPREAD parts; all 255 where one byte does not hold it."""
    n = np.bincount((mix64(shingles + U64(5)) & U64(SPREAD - 1)).astype(np.int64), minlength=SPREAD)
    return (np.full(SPREAD, 255) if n.max() > 254 else n).astype(np.uint8).tobytes()


def may_reach(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Rows of two spreads: whether the sets can reach the similarity. Sets share at most the smaller number in each part, so none that does is refused."""
    most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    most = np.where(most == 255 * SPREAD, np.minimum(nx, ny), most)
    return (100 + percent) * most >= percent * (nx + ny)


def signatures(docs: DataFrame, key: str, text: str, size: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carried columns, n_shingles, two words of a hash of the whole set, the signature and the spread."""
    kinds = dict(docs.dtypes)

    def run(batches):
        known = WordHashes()
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                s = shingle_hashes(known.of(split_words(t, lower=True)), size)
                with np.errstate(over="ignore"):
                    rows.append((len(s), int(np.bitwise_xor.reduce(s).astype(np.int64)) if len(s) else 0, int(mix64(s + U64(11)).sum().astype(np.int64)) if len(s) else 0, signature(s) if len(s) else b"", spread(s) if len(s) else b""))
            yield pd.DataFrame({"key": pdf["key"].array, **{c: pdf[c].array for c in carry}, "n_shingles": [r[0] for r in rows], "set_a": [r[1] for r in rows], "set_b": [r[2] for r in rows], "sig": [r[3] for r in rows], "spread": [r[4] for r in rows]})

    along = "".join(f"{c} {kinds[c]}, " for c in carry)
    return mapped_slices(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *carry), run, f"key {kinds[key]}, {along}n_shingles long, set_a long, set_b long, sig binary, spread binary")


def _keys(sig: np.ndarray) -> np.ndarray:
    """(rows, SLOTS) bytes -> (rows, SLOTS) keys: for each chunk and each symbol left out, the chunk's other symbols."""
    rows = len(sig)
    s = sig.astype(U64).reshape(rows, CHUNKS, WIDTH)
    out = np.empty((rows, CHUNKS, WIDTH), U64)
    for gone in range(WIDTH):
        k = np.zeros((rows, CHUNKS), U64)
        for j in range(WIDTH):
            if j != gone:
                k = (k << U64(8)) | s[:, :, j]
        out[:, :, gone] = k
    mark = np.arange(SLOTS, dtype=U64).reshape(1, CHUNKS, WIDTH) << U64(KEY_BITS)
    return (out | mark).reshape(rows, SLOTS)


def _first_key(same: np.ndarray) -> np.ndarray:
    """(pairs, SLOTS) equal symbols -> the number of the first key of _keys that the pair shares."""
    chunks = same.reshape(-1, CHUNKS, WIDTH)
    first = np.argmax(chunks.sum(axis=2) >= WIDTH - 1, axis=1)
    return first * WIDTH + np.argmin(chunks[np.arange(len(chunks)), first], axis=1)


def _index(reps: DataFrame) -> DataFrame:
    """(bucket, id) for each of the SLOTS keys of each representative."""

    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"bucket": np.empty(0, np.int64), "id": np.empty(0, np.int64)})
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), SLOTS)
        return pd.DataFrame({"bucket": _keys(sig).astype(np.int64).ravel(), "id": np.repeat(pdf["id"].to_numpy(), SLOTS)})

    return mapped(reps.select("id", "sig"), batch, "bucket long, id long")


def _sieved(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """texts without most rows whose id is not in asked; none that is asked for goes. A bit for each hash of an asked id is sent to every task."""
    at = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << SIEVE))
    bits = asked.select(at.alias("at")).groupBy(F.expr("at DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits"))
    placed = texts.withColumn("at", at).withColumn("word", F.expr("at DIV 64")).join(F.broadcast(bits), "word")
    return placed.where("shiftright(bits, CAST(at % 64 AS INT)) & 1 = 1").select(*texts.columns)


def _similar(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity. pairs: staged. texts: id (a row key, so equal ids have equal texts), text."""

    def confirm(batches):
        known = WordHashes()
        last: tuple[int, np.ndarray] | None = None
        for pdf in batches:
            good = []
            for a, ta, tb in zip(pdf["a"], pdf["ta"], pdf["tb"], strict=True):
                if last is None or last[0] != a:
                    last = (a, shingle_hashes(known.of(split_words(ta, lower=True)), size))
                y = shingle_hashes(known.of(split_words(tb, lower=True)), size)
                both = len(last[1]) + len(y) - len(np.union1d(last[1], y))
                good.append(100 * both >= percent * (len(last[1]) + len(y) - both))
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # An inner join with distinct ids: a semi-join would be moved before the sieve, and with it the shuffle of all texts.
    texts = _sieved(texts, asked).join(asked, "id").groupBy("id").agg(F.first("text").alias("text"))
    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return mapped_slices(both.select("a", "b", "ta", "tb"), confirm, "a long, b long")


def _near(percent: int) -> F.Column:
    """Whether at most BOUND symbols of two signatures differ and their spreads allow the similarity."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series, sx: pd.Series, sy: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        p, q = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), SLOTS) for s in (x, y))
        u, v = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), SPREAD) for s in (sx, sy))
        return pd.Series(((p != q).sum(axis=1) <= BOUND) & may_reach(u, v, nx.to_numpy(), ny.to_numpy(), percent))

    return near(*map(F.col, ("sa", "sb", "na", "nb", "pa", "pb")))


def _sizes_allow(percent: int) -> F.Column:
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket in different components that pass the signature bound.

    members: bucket, id, component, n, sig, spread, seat (its place in the bucket), seats.
    A bucket of many blocks is dealt as pairs of blocks, so two blocks at most are held together.
    """
    blocks = F.ceil(F.col("seats") / F.lit(BLOCK)).cast("int")
    own = F.floor(F.col("seat") / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows in group order: each is compared with the d-th after it, for every d that stays in the group, all groups at once."""
        mark, low, high, own = (pdf[c].to_numpy() for c in ("bucket", "low", "high", "own"))
        change = np.r_[True, (mark[1:] != mark[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
        group = np.cumsum(change)
        end = np.r_[np.flatnonzero(change)[1:], len(pdf)][group - 1]
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), SLOTS)
        parts = np.frombuffer(b"".join(pdf["spread"]), np.uint8).reshape(len(pdf), SPREAD)
        component, n, ids = (pdf[c].to_numpy() for c in ("component", "n", "id"))
        a, b, d = [], [], 1
        rows = np.flatnonzero(np.arange(len(pdf)) + 1 < end)
        while len(rows):
            other = rows + d
            may = (component[rows] != component[other]) & ((own[rows] != own[other]) | (low[rows] == high[rows])) & (100 * np.minimum(n[rows], n[other]) >= percent * np.maximum(n[rows], n[other]))
            x, y = rows[may], other[may]
            same = sig[x] == sig[y]
            near = np.flatnonzero((SLOTS - same.sum(axis=1) <= BOUND))
            # Pairs meet in many buckets; the first key that they share reports them.
            near = near[_first_key(same[near]) == mark[x[near]] >> KEY_BITS]
            near = near[may_reach(parts[x[near]], parts[y[near]], n[x[near]], n[y[near]], percent)]
            a.append(ids[x[near]])
            b.append(ids[y[near]])
            d += 1
            rows = rows[rows + d < end[rows]]
        a, b = np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            mark, low, high = (pdf[c].to_numpy() for c in ("bucket", "low", "high"))
            same = (mark == mark[-1]) & (low == low[-1]) & (high == high[-1])
            cut = int(np.argmax(same))
            if cut or (held and tuple(held[-1][["bucket", "low", "high"]].iloc[-1]) != (mark[-1], low[-1], high[-1])):
                yield compare(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield compare(pd.concat(held, ignore_index=True))

    keys = ("bucket", "low", "high")
    sorted_ = dealt.select(*keys, "own", "id", "component", "n", "sig", "spread").repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", keyed: bool = False) -> DataFrame:
    """key, n_shingles, component_id, kept for every document. key must be an integer. keyed: row_key too, to filter rows by."""
    own = F.col(key).cast("long")
    rows = docs.select(row_key(key, text).alias("id"), F.coalesce(own, F.lit(0)).alias("doc"), own.isNull().alias("nameless"), F.col(text).alias("text"))
    marks = staged(signatures(rows, "id", "text", shingle, ("doc", "nameless")).withColumnRenamed("key", "id"), "signatures")
    # Equal sets are one class; one of its rows stands for it. The head is the row that stays.
    head = F.min(F.struct("nameless", "doc", F.col("id").alias("row"))).alias("head")
    sets = ["set_a", "set_b", "n_shingles"]
    classes = staged(marks.where("n_shingles > 0").groupBy(*sets).agg(F.min("id").alias("id"), head, F.first("sig").alias("sig"), F.first("spread").alias("spread")), "classes")
    reps = classes.select("id", F.col("n_shingles").alias("n"), "sig", "spread")
    index = _index(classes)
    buckets = index.groupBy("bucket").agg(F.count("*").alias("seats")).where("seats > 1")
    met = staged(index.join(buckets, "bucket"), "buckets")
    # A text that the others are copies of meets more members than they do: the bucket's busiest member is its pivot.
    busy = met.groupBy("id").agg(F.sum(F.col("seats") - 1).alias("busy"))
    pivots = met.join(busy, "id").groupBy("bucket").agg(F.max(F.struct("busy", F.bitwise_not("id").alias("id"))).alias("p")).select("bucket", F.bitwise_not("p.id").alias("pivot"))
    shared = staged(met.join(pivots, "bucket"), "pivots")
    dropped(met)
    tries = shared.where("pivot <> id").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    sized = tries.join(reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"), F.col("spread").alias("pb")), "b").join(reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"), F.col("spread").alias("pa")), "a")
    tries = staged(sized.where(_sizes_allow(percent)).where(_near(percent)).select("a", "b"), "tries")
    texts = rows.select("id", "text")
    first = staged(_similar(tries, texts, shingle, percent), "links")
    dropped(tries)
    joined = connected_components(first)
    # What is left: members of one bucket in different components.
    labelled = shared.join(joined, "id", "left").select("bucket", "id", "seats", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    left = labelled.join(mixed, "bucket").join(reps, "id")
    left = left.withColumn("seat", F.pmod(F.xxhash64("id"), F.lit(BLOCK) * F.ceil(F.col("seats") / F.lit(BLOCK))))
    across = staged(_across(left, percent), "across")
    second = staged(_similar(across, texts, shingle, percent), "links")
    dropped(shared, across)
    final = connected_components(first.union(second))
    dropped(first, second)
    named = classes.select(*sets, "id", "head").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = named.groupBy("component").agg(F.min("head").alias("head"))
    named = named.drop("head").join(heads, "component").select(*sets, "head")
    out = marks.select("id", "doc", "nameless", *sets).join(named, sets, "left").withColumn("head", F.coalesce("head", F.struct("nameless", "doc", F.col("id").alias("row"))))
    columns = (F.when(~F.col("nameless"), F.col("doc")).alias(key), "n_shingles", F.when(~F.col("head.nameless"), F.col("head.doc")).alias("component_id"), (F.col("id") == F.col("head.row")).alias("kept"))
    return out.select(*columns, *([F.col("id").alias("row_key")] if keyed else []))
