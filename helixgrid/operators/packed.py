"""Long words, shuffled packed: counts of windows, and sums of tables.

Nearly every window of a long word is a word of its own, so partial counts do
not shrink what a count shuffles. Here a sequence is cut where the smallest hash of
the M-mers in a window changes (super-k-mers: windows that share it travel as one
stretch of two-bit bases, about a byte a window). Equal words share that hash, in both orientations if words
are canonical, so each meets its like in one task. Sums of tables travel as sorted
codes, each as its distance from the one before.

A task holds what it gets packed, and unpacks it in passes of about HELD words,
so its memory grows by a few bytes a word. A word is a pair of codes of 64 bits: its first
32 bases, and the rest (for up to 32 bases there is no second one).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES, check_k
from .codes import _PLACE, BLOCK, COMBINED, pieces_of

#: The longest word that is counted by its code alone (see codes): of longer ones most are distinct.
SHORT_K = 12
#: Words that a pass unpacks, words of a range that is stored, rows of a batch that leaves Python, bytes of input (as Spark estimates them) to a task, and the most tasks planned.
HELD, RANGE, ROWS, SHARE, MOST = 1 << 21, 1 << 23, 1 << 16, 4 << 20, 4096
#: Codes of a task that bounds of ranges are taken from, and one of how many windows is looked at for it.
SAMPLE, EVERY = 512, 32

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_FOUR = np.array([[i >> 6 & 3, i >> 4 & 3, i >> 2 & 3, i & 3] for i in range(256)], np.uint8)
_LETTERS = np.frombuffer(BASES.encode(), np.uint8)[_FOUR]

Words = tuple[np.ndarray, "np.ndarray | None"]


def tasks_for(df: DataFrame) -> int:
    """Tasks to shuffle df to: by its size as Spark estimates it where it does, never fewer than the session's shuffles have. Any number is right."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size > 1 << 50 else max(least, min(MOST, size // SHARE))


# -- words as codes ------------------------------------------------------------------------------------


def _spans(place: np.ndarray, width: int, both: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Codes of width bases at every place, and of their reverse complements."""
    one = place.astype(U64)
    fwd, rev, done = one, U64(3) - one if both else None, 1
    for digit in bin(width)[3:]:
        n = len(fwd) - done
        shift = U64(2 * done)
        if both:
            rev = (rev[done:] << shift) | rev[:n]
        fwd = (fwd[:n] << shift) | fwd[done:]
        done *= 2
        if digit == "1":
            n = len(fwd) - 1
            last = one[done : done + n]
            if both:
                rev = ((U64(3) - last) << U64(2 * done)) | rev[:n]
            fwd = (fwd[:n] << U64(2)) | last
            done += 1
    return fwd, rev


def _words_at(place: np.ndarray, at: np.ndarray, k: int, canonical: bool) -> Words:
    """The words that begin at some places."""
    head = min(k, 32)
    fwd, rev = _spans(place, head, canonical)
    hi = fwd[at]
    if k <= 32:
        return (np.minimum(hi, rev[at]) if canonical else hi), None
    tail, back = _spans(place, k - 32, canonical)
    lo = tail[at + 32]
    if canonical:
        other_hi, other_lo = rev[at + (k - 32)], back[at]
        swap = (other_hi < hi) | ((other_hi == hi) & (other_lo < lo))
        hi, lo = np.where(swap, other_hi, hi), np.where(swap, other_lo, lo)
    return hi, lo


def _letters(words: Words, k: int):
    """Words as an Arrow column of strings."""
    import pyarrow as pa

    parts = []
    for codes, width in zip(words, (min(k, 32), k - 32), strict=True):
        if width <= 0:
            continue
        four = -(-width // 4)
        # Highest byte first; the bytes of unused high bits, and letters of unused bits of the first, are left out.
        as_bytes = np.ascontiguousarray(codes).astype(">u8").view(np.uint8).reshape(len(codes), 8)[:, 8 - four :]
        parts.append(_LETTERS[as_bytes].reshape(len(codes), 4 * four)[:, 4 * four - width :])
    data = np.ascontiguousarray(np.concatenate(parts, axis=1) if len(parts) > 1 else parts[0])
    ends = np.arange(0, (len(data) + 1) * k, k, dtype=np.int32)
    return pa.Array.from_buffers(pa.string(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _parsed(column, k: int) -> Words:
    """The codes of an Arrow column of words; anything but k upper-case bases is an error."""
    import pyarrow as pa

    n = len(column)
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if column.null_count or len(data) != n * k or (np.diff(ends) != k).any():
        raise ValueError(f"a table has words that are not of {k} bases")
    place = _PLACE[data]
    if (place > 3).any() or (data > 90).any():
        raise ValueError("a table has words with other letters than A, C, G, T")
    columns = place.reshape(n, k).T.astype(U64)
    codes = []
    for part in (columns[:32], columns[32:]):
        code = np.zeros(n, U64)
        for base in part:
            code = (code << U64(2)) | base
        codes.append(code)
    return codes[0], codes[1] if k > 32 else None


def _joined(parts: list[Words]) -> Words:
    return np.concatenate([p[0] for p in parts]), None if parts[0][1] is None else np.concatenate([p[1] for p in parts])


def _in_order(words: Words, counts: np.ndarray | None) -> tuple[Words, np.ndarray]:
    """Distinct words in order and their counts summed; without counts each stands for one."""
    hi, lo = words
    if lo is None and counts is None:
        hi = np.sort(hi)
    else:
        order = np.argsort(hi, kind="stable") if lo is None else np.lexsort((lo, hi))
        hi, lo, counts = hi[order], None if lo is None else lo[order], None if counts is None else counts[order]
    new = hi[1:] != hi[:-1]
    if lo is not None:
        new |= lo[1:] != lo[:-1]
    first = np.flatnonzero(np.r_[True, new])
    if counts is None:
        sums = np.diff(np.r_[first, len(hi)])
    else:
        sums = np.add.reduceat(counts, first)
        if counts.max() > np.iinfo(np.int64).max // len(counts) and np.add.reduceat(counts.astype(float), first).max() > 9.2e18:
            raise OverflowError("a sum of counts is over 64 bits")
    return (hi[first], None if lo is None else lo[first]), sums.astype(np.int64)


def _batches(words: Words, counts: np.ndarray, k: int) -> Iterator:
    import pyarrow as pa

    for at in range(0, len(counts), ROWS):
        cut = slice(at, at + ROWS)
        yield pa.RecordBatch.from_arrays([_letters((words[0][cut], None if words[1] is None else words[1][cut]), k), pa.array(counts[cut])], names=["kmer", "count"])


def _mixed(words: Words) -> np.ndarray:
    """A hash of words, for passes."""
    h = words[0] * U64(_ODD)
    if words[1] is not None:
        h = (h ^ (h >> U64(29)) ^ words[1]) * U64(_ODD)
    return h ^ (h >> U64(32))


# -- counting ------------------------------------------------------------------------------------------


def _blobs(data: np.ndarray, ends: np.ndarray):
    """An Arrow column of the stretches of a byte array that end at `ends`."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _stretches(data: np.ndarray, k: int, m: int, canonical: bool, parts: int) -> tuple[np.ndarray, ...]:
    """Of a byte array: place, and (start, windows, part) of each stretch of windows of one part, 255 windows at most."""
    place = _PLACE[data]
    bad = np.flatnonzero(place > 3)
    place &= 3
    one = place.astype(np.uint32)
    fwd, rev = _small_spans(one, m, canonical)
    h = np.minimum(fwd, rev) if canonical else fwd
    h = (h + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    # The smallest of the k - m + 1 hashes of each window, by doubling.
    width, wanted = 1, k - m + 1
    while width < wanted:
        step = min(width, wanted - width)
        h = np.minimum(h[:-step], h[step:])
        width += step
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
    part = ((h.astype(U64) * U64(parts)) >> U64(32)).astype(np.int32)
    if len(bad):
        drop = np.zeros(len(data) + 1, np.int32)
        np.add.at(drop, np.maximum(bad - k + 1, 0), 1)
        np.add.at(drop, bad + 1, -1)
        part[np.cumsum(drop)[: len(part)] > 0] = -1
    start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    n = np.diff(np.r_[start, len(part)])
    good = part[start] >= 0
    start, n = start[good], n[good]
    of = part[start]
    if len(n) and n.max() > 255:
        cut = -(-n // 255)
        nth = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        start, n, of = np.repeat(start, cut) + 255 * nth, np.minimum(np.repeat(n, cut) - 255 * nth, 255), np.repeat(of, cut)
    return place, start, n, of


def _small_spans(one: np.ndarray, width: int, both: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """As _spans, in 32 bits."""
    n = len(one) - width + 1
    fwd, rev = np.zeros(n, np.uint32), np.zeros(n, np.uint32) if both else None
    for i in range(width):
        base = one[i : i + n]
        fwd = (fwd << np.uint32(2)) | base
        if both:
            rev |= (np.uint32(3) - base) << np.uint32(2 * i)
    return fwd, rev


def _dealt(held: list[tuple], k: int):
    """Stretches of several blocks as a row for each part: part, windows of each stretch, packed bases."""
    import pyarrow as pa

    shift = np.cumsum([0, *[len(h[0]) for h in held]])
    place = np.concatenate([*[h[0] for h in held], np.zeros(4, np.uint8)])
    start = np.concatenate([h[1] + s for h, s in zip(held, shift, strict=False)])
    n, part = (np.concatenate([h[i] for h in held]) for i in (2, 3))
    order = np.argsort(part, kind="stable")
    start, n, part = start[order], n[order], part[order]
    last = np.flatnonzero(np.r_[part[1:] != part[:-1], True])
    bases = n + (k - 1)
    # A part's bases fill whole bytes.
    ends = np.cumsum(bases)[last]
    bases[last] += -np.diff(np.r_[0, ends]) % 4
    whole = np.cumsum(bases)
    at = np.repeat((start - (whole - bases)).astype(np.int32), bases)
    at += np.arange(whole[-1], dtype=np.int32)
    four = place[at].reshape(-1, 4)
    packed = (four[:, 0] << 6) | (four[:, 1] << 4) | (four[:, 2] << 2) | four[:, 3]
    return pa.RecordBatch.from_arrays([pa.array(part[last].astype(np.int32)), _blobs(n.astype(np.uint8), last + 1), _blobs(packed, whole[last] // 4)], names=["part", "n", "bases"])


def _unpacked(rows: list[tuple[bytes, bytes]], k: int, canonical: bool) -> Words:
    """All words of some rows of _dealt."""
    n = [np.frombuffer(r[0], np.uint8) for r in rows]
    last = np.cumsum([len(x) for x in n]) - 1
    n = np.concatenate(n).astype(np.int64)
    bases = n + (k - 1)
    bases[last] += -np.diff(np.r_[0, np.cumsum(bases)[last]]) % 4
    place = _FOUR[np.frombuffer(b"".join(r[1] for r in rows), np.uint8)].reshape(-1)
    start = np.cumsum(bases) - bases
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return _words_at(place, at, k, canonical)


def _counted(rows: list[tuple[bytes, bytes]], k: int, canonical: bool) -> Iterator[tuple[Words, np.ndarray]]:
    """Distinct words of rows of _dealt and their counts, in passes by a hash."""
    total = sum(int(np.frombuffer(r[0], np.uint8).sum()) for r in rows)
    passes = -(-total // HELD)
    for turn in range(passes):
        held: list[Words] = []
        done: list[tuple[Words, np.ndarray]] = []
        size = at = 0
        while at < len(rows):
            some, n = at, 0
            while at < len(rows) and (n < BLOCK or at == some):
                n += 16 * len(rows[at][0])
                at += 1
            words = _unpacked(rows[some:at], k, canonical)
            if passes > 1:
                mine = _mixed(words) % U64(passes) == turn
                words = (words[0][mine], None if words[1] is None else words[1][mine])
            held.append(words)
            size += len(words[0])
            # More than a pass should have: words that repeat.
            if size > 2 * HELD:
                done.append(_in_order(_joined(held), None))
                held, size = [], 0
        if size:
            done.append(_in_order(_joined(held), None))
        if len(done) > 1:
            done = [_in_order(_joined([d[0] for d in done]), np.concatenate([d[1] for d in done]))]
        yield from done


@dataclass(frozen=True)
class Source:
    """Rows and what makes words and counts of their batches (a word may come more than once), for the shuffles of sums."""

    rows: DataFrame
    words: Callable[[Iterator], Iterator[tuple[Words, np.ndarray]]]
    tasks: int


def counted_source(sequences: DataFrame, k: int, canonical: bool = False, seq: str = "seq") -> Source:
    """Stretches of sequences, dealt; each word comes once."""
    check_k(k)
    m, parts = min(12, max(8, k // 2)), tasks_for(sequences)

    def cut(batches) -> Iterator:
        held: list[tuple] = []
        total = 0
        for data in _bytes_of(batches):
            for at in range(0, len(data), BLOCK):
                block = data[at : at + BLOCK + k - 1]
                if len(block) < k:
                    continue
                held.append(_stretches(block, k, m, canonical, parts))
                total += len(block)
                if total >= COMBINED // 2:
                    if any(len(h[1]) for h in held):
                        yield _dealt(held, k)
                    held, total = [], 0
        if any(len(h[1]) for h in held):
            yield _dealt(held, k)

    def count(batches) -> Iterator:
        rows = [(n, b) for batch in batches for n, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return _counted(rows, k, canonical)

    dealt = pieces_of(sequences, k, seq).mapInArrow(cut, "part int, n binary, bases binary").repartitionById(parts, F.col("part"))
    return Source(dealt, count, parts)


def packed_counts(sequences: DataFrame, k: int, canonical: bool = False, seq: str = "seq") -> DataFrame:
    """kmer, count over all sequences, for words of over SHORT_K bases."""
    source = counted_source(sequences, k, canonical, seq)

    def run(batches, words=source.words) -> Iterator:
        for found, counts in words(batches):
            yield from _batches(found, counts, k)

    return source.rows.mapInArrow(run, "kmer string, count long")


def table_source(table: DataFrame, k: int) -> Source:
    """The rows of a table (kmer, count); words of another length, or of other letters, are an error."""

    def words(batches) -> Iterator:
        for batch in batches:
            if len(batch.column(0)):
                if batch.column(1).null_count or (n := batch.column(1).to_numpy()).min() < 0:
                    raise ValueError("a table has counts that are null or negative")
                yield _parsed(batch.column(0), k), n

    return Source(table.select("kmer", F.col("count").cast("long").alias("count")), words, tasks_for(table))


def _bytes_of(batches) -> Iterator[np.ndarray]:
    """The bytes of each batch's first column; every row ends with a byte that is no base, so its rows are one array."""
    import pyarrow as pa

    for batch in batches:
        column = batch.column(0)
        if len(column):
            ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
            if ends[-1] > ends[0]:
                yield np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]


# -- sums ----------------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers, lowest bytes of all first; high ones that are zero everywhere are left out."""
    low = x.astype("<u8").view(np.uint8).reshape(len(x), 8)
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(low[:, :width].T)


def _numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(n)


def _squeezed(x: np.ndarray, entropy_only: bool) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY if entropy_only else zlib.Z_DEFAULT_STRATEGY)
    return squeeze.compress(_planes(x)) + squeeze.flush()


def _row(words: Words, counts: np.ndarray) -> tuple:
    """Words in order and their counts as (n, first, steps, rest, counts)."""
    hi, lo = words
    return len(hi), int(hi[0].astype(np.int64)), _squeezed(np.diff(hi, prepend=hi[:1]), True), b"" if lo is None else _squeezed(lo, True), _squeezed(counts.astype(U64), False)


def _unrow(row: tuple) -> tuple[Words, np.ndarray]:
    n, first, steps, rest, counts = row[:5]
    hi = np.cumsum(_numbers(zlib.decompress(steps, -15), n), dtype=U64) + np.int64(first).astype(U64)
    return (hi, _numbers(zlib.decompress(rest, -15), n) if rest else None), _numbers(zlib.decompress(counts, -15), n).astype(np.int64)


#: rows: how many rows of the table they were.
_ROW = "part int, n long, first long, steps binary, rest binary, counts binary, rows long"


def _hashing(k: int) -> tuple[U64, U64, U64]:
    """Factor, its inverse and mask of a one-to-one map of the codes of a word's first 32 bases."""
    bits = 2 * min(k, 32)
    return U64(_ODD % (1 << bits)), U64(pow(_ODD, -1, 1 << bits)), U64((1 << bits) - 1)


def _passes(rows: list[tuple]) -> Iterator[tuple[Words, np.ndarray]]:
    """Sums of the words of rows of _row, in order, in passes by ranges of about HELD words."""
    total = sum(r[0] for r in rows)
    if not total:
        return
    bounds = np.empty(0, U64)
    if total > HELD:
        seen = np.sort(np.concatenate([_unrow(r)[0][0][::64] for r in rows]))
        bounds = np.unique(seen[np.arange(1, -(-total // HELD)) * len(seen) // -(-total // HELD)])
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        words, counts = [], []
        for r in rows:
            (hi, lo), n = _unrow(r)
            cut = slice(0 if low is None else np.searchsorted(hi, low), len(hi) if high is None else np.searchsorted(hi, high))
            words.append((hi[cut], None if lo is None else lo[cut]))
            counts.append(n[cut])
        if sum(map(len, counts)):
            yield _in_order(_joined(words), np.concatenate(counts))


def _shuffled(sources: list[Source], k: int, bounds: np.ndarray | None = None) -> DataFrame:
    """The words of all sources as packed rows, each range of codes in its task; without bounds, of their hashes."""
    hashed = bounds is None
    if hashed:
        bounds = _even(k, sum(s.tasks for s in sources))
    packs = [s.rows.mapInArrow(_packer(s.words, k, bounds, hashed), _ROW) for s in sources]
    return reduce(DataFrame.union, packs).repartitionById(len(bounds) + 1, F.col("part"))


def _packer(words: Callable, k: int, bounds: np.ndarray, hashed: bool) -> Callable[[Iterator], Iterator]:
    by, _, mask = _hashing(k)

    def pack(batches) -> Iterator:
        import pyarrow as pa

        held: list[Words] = []
        counts: list[np.ndarray] = []
        total = 0

        def flush():
            every = _joined(held)
            (hi, lo), n = _in_order(every, np.concatenate(counts))
            own = np.bincount(np.searchsorted(bounds, every[0], "right"), minlength=len(bounds) + 1)
            ends = np.r_[0, np.searchsorted(hi, bounds), len(hi)]
            rows = [(i, *_row((hi[a:b], None if lo is None else lo[a:b]), n[a:b]), int(own[i])) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
            held.clear()
            counts.clear()
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "n", "first", "steps", "rest", "counts", "rows"])

        for (hi, lo), n in words(batches):
            held.append(((hi * by) & mask if hashed else hi, lo))
            counts.append(n)
            total += len(n)
            if total >= COMBINED:
                yield flush()
                total = 0
        if total:
            yield flush()

    return pack


def _rows_of(batches) -> list[tuple]:
    return [r for batch in batches for r in zip(*[batch.column(i).to_pylist() for i in range(1, 7)], strict=True)]


def _even(k: int, parts: int) -> np.ndarray:
    """Bounds of equal ranges of all codes."""
    return np.unique(np.array([(i << (2 * min(k, 32))) // parts for i in range(1, parts)], U64))


def packed_sums(sources: list[Source], k: int) -> DataFrame:
    """kmer, count: counts summed by word."""
    _, back, mask = _hashing(k)

    def add(batches) -> Iterator:
        for (hi, lo), n in _passes(_rows_of(batches)):
            yield from _batches(((hi * back) & mask, lo), n, k)

    return _shuffled(sources, k).mapInArrow(add, "kmer string, count long")


def packed_totals(sources: list[Source], k: int) -> DataFrame:
    """rows_in, rows_out, total: how many rows and distinct words there are, and the sum of counts; a row for each task."""

    def add(batches) -> Iterator:
        import pyarrow as pa

        rows = _rows_of(batches)
        rows_in = sum(r[5] for r in rows)
        rows_out = total = 0
        for words, n in _passes(rows):
            rows_out, total = rows_out + len(words[0]), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (rows_in, rows_out, total)], names=["rows_in", "rows_out", "total"])

    return _shuffled(sources, k).mapInArrow(add, "rows_in long, rows_out long, total long")


def packed_in_order(sources: list[Source], k: int, bounds: np.ndarray) -> DataFrame:
    """As packed_sums, in word order: each partition holds a range of words, and ranges do not overlap."""

    def add(batches) -> Iterator:
        for words, n in _passes(_rows_of(batches)):
            yield from _batches(words, n, k)

    return _shuffled(sources, k, bounds).mapInArrow(add, "kmer string, count long")


# -- bounds of ranges ----------------------------------------------------------------------------------


def _thinned(parts: Iterator[np.ndarray]) -> Iterator:
    """One row: how many codes there were, and SAMPLE of them or all."""
    import pyarrow as pa

    kept, seen, step = np.empty(0, U64), 0, 1
    for codes in parts:
        first = -seen % step
        seen += len(codes)
        kept = np.r_[kept, codes[first::step]]
        while len(kept) > 2 * SAMPLE:
            kept, step = kept[::2], 2 * step
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([kept.tobytes()], pa.binary())], names=["n", "codes"])


def windows_like(sequences: DataFrame, k: int, canonical: bool, seq: str = "seq") -> DataFrame:
    """n, codes: some of the words of sequences, for bounds of the ranges that a count is stored in."""

    def run(batches) -> Iterator:
        def parts():
            for data in _bytes_of(batches):
                for at in range(0, len(data), BLOCK):
                    block = data[at : at + BLOCK // EVERY + k - 1]
                    if len(block) >= k:
                        place = _PLACE[block]
                        bad = np.r_[0, np.cumsum(place > 3)]
                        at_ = np.flatnonzero(bad[k:] == bad[:-k])
                        yield _words_at(place & 3, at_, k, canonical)[0]

        for batch in _thinned(parts()):
            yield batch.set_column(0, "n", _scaled(batch.column(0)))

    return pieces_of(sequences, k, seq).mapInArrow(run, "n long, codes binary")


def _scaled(n):
    import pyarrow as pa

    return pa.array([x * EVERY for x in n.to_pylist()], pa.int64())


def rows_like(table: DataFrame, k: int) -> DataFrame:
    """As windows_like, of the rows of a table."""

    def run(batches) -> Iterator:
        for batch in _thinned(_parsed(b.column(0), k)[0] for b in batches if len(b.column(0))):
            yield batch.set_column(0, "n", _scaled(batch.column(0)))

    # Few rows go to Python, by a hash of the word.
    return table.select("kmer").where(F.pmod(F.xxhash64("kmer", F.lit(5)), F.lit(EVERY)) == 0).mapInArrow(run, "n long, codes binary")


def bounds_of(like: DataFrame, files: int | None = None) -> np.ndarray:
    """Where ranges of about RANGE words begin (or `files` ranges), by some codes of each task."""
    rows = [(r["n"], np.frombuffer(r["codes"], U64)) for r in like.collect()]
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return np.empty(0, U64)
    codes = np.concatenate([c for _, c in rows])
    weight = np.concatenate([np.full(len(c), n / len(c)) for n, c in rows])
    files = files or max(1, min(MOST, -(-sum(n for n, _ in rows) // RANGE)))
    order = np.argsort(codes)
    reached = np.cumsum(weight[order])
    return np.unique(codes[order][np.searchsorted(reached, reached[-1] * np.arange(1, files) / files)])
