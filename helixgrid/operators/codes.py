"""Windows as two-bit codes, counted by Arrow batch.

For k of up to 31 a word is a BIGINT (A=0, C=1, G=2, T=3, first base highest), so
the shuffle of a count carries 16 bytes a distinct word instead of a string a
window. Codes of k bases are put together from codes of halves, so that the
work of a window grows with log k; equal codes of a block are combined before
they leave Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import check_k, unpacked

#: The longest word whose code is a non-negative BIGINT.
CODED_K = 31
#: Bases of a row that travel together (a batch of 10,000 such rows is 20 MB, however long the sequences are), windows that are coded at once (in a
#: core's cache), and windows that are combined at once.
PIECE, BLOCK, COMBINED = 1 << 11, 1 << 16, 1 << 21

_PLACE = np.full(256, 4, np.uint8)
for _i, _bases in enumerate(("Aa", "Cc", "Gg", "Tt")):
    for _b in _bases:
        _PLACE[ord(_b)] = _i


def window_codes(data: np.ndarray, k: int, canonical: bool) -> np.ndarray:
    """The codes of all windows of k bases in a byte array; windows with any other byte are left out."""
    if len(data) < k:
        return np.empty(0, np.int32 if k <= 15 else np.int64)
    place = _PLACE[data]
    bad = place > 3
    ends = np.flatnonzero(bad)
    one = (place & 3).astype(np.int32 if k <= 15 else np.int64)
    fwd, rev = one, 3 - one
    width = 1
    # Binary digits of k from the second highest: double the width, then add one base where the digit is set.
    for digit in bin(k)[3:]:
        n = len(fwd) - width
        if canonical:
            rev = (rev[width:] << (2 * width)) | rev[:n]
        fwd = (fwd[:n] << (2 * width)) | fwd[width:]
        width *= 2
        if digit == "1":
            n = len(fwd) - 1
            last = one[width : width + n]
            if canonical:
                rev = ((3 - last) << (2 * width)) | rev[:n]
            fwd = (fwd[:n] << 2) | last
            width += 1
    if canonical:
        np.minimum(fwd, rev, out=fwd)
    if len(ends):
        # A window is good if no bad byte lies in it: windows from the last k-1 places before a bad one to it go.
        drop = np.zeros(len(data) + 1, np.int32)
        np.add.at(drop, np.maximum(ends - k + 1, 0), 1)
        np.add.at(drop, ends + 1, -1)
        fwd = fwd[np.cumsum(drop)[: len(fwd)] == 0]
    return fwd


def _combined(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often they occur."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.diff(np.r_[first, len(codes)])


def coded_counts(sequences: DataFrame, k: int, canonical: bool = False, seq: str = "seq") -> DataFrame:
    """code, n: partial counts of window codes; a code may come from several batches."""
    if check_k(k) > CODED_K:
        raise ValueError(f"words of over {CODED_K} bases have no code of 64 bits")

    def run(batches) -> Iterator:
        import pyarrow as pa

        held: list[np.ndarray] = []
        total = 0

        def flush():
            codes, n = _combined(np.concatenate(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
            # Each row ends with a byte that is no base, so rows of a batch are one array.
            data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
            for at in range(0, len(data), BLOCK):
                codes = window_codes(data[at : at + BLOCK + k - 1], k, canonical)
                if len(codes):
                    held.append(codes)
                    total += len(codes)
                if total >= COMBINED:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return pieces_of(sequences, k, seq).mapInArrow(run, "code long, n long")


def pieces_of(sequences: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Rows of any length in overlapping pieces of bounded size, each closed by a byte that is no base; short rows have none."""
    raw = sequences.select(F.col(seq).cast("binary").alias("_b"))
    # A filter on the length would be pushed down and make the sequence twice.
    last = F.length("_b") - (k - 1)
    at = F.explode(F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(PIECE))))
    return raw.withColumn("_at", at).select(F.concat(F.substring(F.col("_b"), F.col("_at"), F.lit(PIECE + k - 1)), F.lit(b"\n")).alias("_p"))


def counted_codes(sequences: DataFrame, k: int, canonical: bool = False, seq: str = "seq") -> DataFrame:
    """kmer, count through codes; letters are made of the distinct codes only."""
    sums = coded_counts(sequences, k, canonical, seq).groupBy("code").agg(F.sum("n").alias("count"))
    return sums.select(unpacked(F.col("code"), k).alias("kmer"), "count")
