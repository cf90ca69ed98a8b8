"""Context-triggered piecewise hashing of documents.

A rolling hash over the last seven bytes ends a chunk wherever its value is
one below a multiple of the block size; each chunk's hash becomes one of 64
characters. A fingerprint is `block:first:second`, where second is the
signature at twice the block size, so texts whose block sizes are equal or a
factor of two apart can be compared. The block size is the smallest 3 * 2^n
that fits the text's length into 64 chunks, halved while that leaves under 32
of them. Two signatures are compared by edit distance (insertions and
deletions), and only if they share a run of four characters or are too short
to hold one; likeness is 1 - distance / (both lengths).

Everything per byte is array arithmetic, and the edit distance is computed
for a whole batch at once, in the bits of one word per pair.

Defined cases: null text is empty; the empty text's fingerprint is `3::`;
equal texts have equal fingerprints and likeness 1; the next document of a
single one is itself; ties of the order key follow the text's hash, and equal
rows any order; null ids come first; very long texts are hashed whole, in
arrays of a few bytes for each of theirs; further columns, whatever their names, are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, mapped, mix64, staged

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODES = np.frombuffer(ALPHABET.encode(), np.uint8)
LEAST_BLOCK, LENGTH, WINDOW, GRAM = 3, 64, 7, 4
_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the chunk hash's base, grown on demand."""

    up, down = _powers(_PRIME, 1 << 12), _powers(_INVERSE, 1 << 12)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_PRIME, 2 * n), _powers(_INVERSE, 2 * n)
        return cls.up, cls.down


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of it and the six before it: their sum, their sum weighted by place, and their shifted exclusive or."""
    padded = np.zeros(len(data) + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 :] = data
    total, placed, shifted = (np.zeros(len(data), np.uint32) for _ in range(3))
    for j in range(WINDOW):
        part = padded[j : j + len(data)]
        total += part
        placed += part * np.uint32(j + 1)
        shifted ^= part << np.uint32(5 * (WINDOW - 1 - j))
    return total + placed + shifted


def _signature(ends: np.ndarray, sums: np.ndarray, down: np.ndarray, n: int) -> str:
    """One character per chunk; the rest after the last end is a chunk too. Beyond LENGTH - 1 ends, all that follows is one chunk."""
    ends = ends[: LENGTH - 1] + 1
    if not len(ends) or ends[-1] < n:
        ends = np.r_[ends, n]
    starts = np.r_[0, ends[:-1]]
    value = (sums[ends] - sums[starts]) * down[starts]
    return _CODES[(mix64(value + U64(1)) >> U64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | bytes | None) -> str:
    raw = (text or "").encode("utf-8", "surrogatepass") if not isinstance(text, bytes) else text
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    block = LEAST_BLOCK
    while block * LENGTH < n:
        block *= 2
    up, down = _Tables.of(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    h = rolling(data)
    ends = np.flatnonzero(h % np.uint32(block) == block - 1)
    while block > LEAST_BLOCK and len(ends) < LENGTH // 2:
        block //= 2
        ends = np.flatnonzero(h % np.uint32(block) == block - 1)
    # What ends a chunk at twice the block size also ends one at the block size.
    double = ends[h[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(ends, sums, down, n)}:{_signature(double, sums, down, n)}"


_CODE_OF = np.zeros(256, np.int64)
_CODE_OF[_CODES] = np.arange(64)


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of signatures (at most 64 characters), bit-parallel."""
    n = len(a)
    rows = np.arange(n)
    la, lb = (np.fromiter(map(len, s), np.int64, n) for s in (a, b))
    x, y = (_CODE_OF[np.frombuffer("".join(t.ljust(LENGTH, "A") for t in s).encode(), np.uint8)].reshape(n, LENGTH) for s in (a, b))
    places = np.zeros((n, 64), U64)
    for i in range(LENGTH):
        own = rows[la > i]
        places[own, x[own, i]] |= U64(1 << i)
    v = np.full(n, np.iinfo(np.uint64).max, U64)
    for j in range(int(lb.max(initial=0))):
        m = places[rows, y[:, j]]
        u = v & m
        v = np.where(lb > j, (v + u) | (v - u), v)
    return np.bitwise_count(~v & np.where(la >= 64, np.iinfo(np.uint64).max, (U64(1) << la.astype(U64) % U64(64)) - U64(1))).astype(np.int64)


def _share_run(a: str, b: str) -> bool:
    k = min(GRAM, len(a), len(b))
    grams = {a[i : i + k] for i in range(len(a) - k + 1)}
    return any(b[i : i + k] in grams for i in range(len(b) - k + 1))


def likeness(first: list[str], second: list[str]) -> np.ndarray:
    """Likeness of fingerprints, pair by pair, between 0 and 1; 0 if their block sizes are not compatible."""
    out = np.zeros(len(first))
    owner, left, right = [], [], []
    for i, (f, s) in enumerate(zip(first, second, strict=True)):
        if f == s:
            out[i] = 1
            continue
        a, b = f.split(":"), s.split(":")
        p, q = int(a[0]), int(b[0])
        pairs = [(a[1], b[1]), (a[2], b[2])] if p == q else [(a[1], b[2])] if p == 2 * q else [(a[2], b[1])] if q == 2 * p else []
        for x, y in pairs:
            if x and y and _share_run(x, y):
                owner.append(i)
                left.append(x)
                right.append(y)
    if owner:
        total = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)])
        # Different fingerprints are never quite alike.
        np.maximum.at(out, owner, np.minimum(2 * _common(left, right) / total, 0.99))
    return out


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down, in code points) replaced by as much of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _judged(keys: list, texts: list[str], marks: list[str], following: list[str], theirs: list[str]) -> dict[str, list]:
    """The result's columns for documents, their fingerprints, and their followers with theirs."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    again = [fingerprint(c) for c in changed]
    return {
        "key": keys, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
        "fingerprint": marks, "edited_fingerprint": again, "near_edited": likeness(marks, again).tolist(), "near_next": likeness(marks, theirs).tolist(),
    }


RESULT = "key string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Spark deals the documents by ranges of (key, hash of the text) and sorts each range, so a document meets its
    follower in one pass. Of each range the first and the last document, whose neighbours are elsewhere, are put
    aside with their texts and meet in a join of two rows a range; no bound or text reaches the driver.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Equal rows have any order among themselves; their place in the scan lets ranges split them.
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), F.monotonically_increasing_id().alias("seat"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = (F.col("key").asc_nulls_first(), "tie", "seat")
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    columns = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches):
        held: tuple | None = None  # (key, text, fingerprint): waits for its follower
        part = 0
        for pdf in batches:
            done: list[tuple] = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                own = fingerprint(t)
                if held is None:
                    part = int(pdf["part"].iloc[0])
                    yield aside("first", part, k, t, own)
                else:
                    done.append((*held, t, own))
                held = (k, t, own)
            if done:
                k, t, m, f, n = zip(*done, strict=True)
                yield pd.DataFrame({**_judged(list(k), list(t), list(m), list(f), list(n)), "end": None, "part": part, "text": None})
        if held is not None:
            yield aside("last", part, *held)

    def aside(end: str, part: int, k, t: str, mark: str) -> pd.DataFrame:
        return pd.DataFrame([{**dict.fromkeys(columns), "key": k, "fingerprint": mark, "end": end, "part": part, "text": t}])

    keyed = ranges.select(F.col("key").cast("string").alias("key"), F.spark_partition_id().alias("part"), "text")
    found = staged(keyed.mapInPandas(run, f"{RESULT}, end string, part int, text string"), "fingerprints")
    first = found.where("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("theirs"))
    # One number for each range that has rows; the range after the last is the first one.
    numbers = found.where("end = 'first'").select("part")
    after = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    seams = found.where("end = 'last'").join(after, "part").join(first, "next").select("key", "text", "fingerprint", "following", "theirs")
    met = mapped(seams, lambda pdf: pd.DataFrame(_judged(*(pdf[c].tolist() for c in ("key", "text", "fingerprint", "following", "theirs")))), RESULT)
    out = found.where("end is null").select(*columns).union(met)
    return out.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)
