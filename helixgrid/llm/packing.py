"""Best-two-fit packing of token sequences.

Documents become token ids with an end id; only longer ones are cut, into
pieces of the full length with the shorter piece first. A sequence is filled
greedily, largest piece that fits first; then its smallest piece is replaced
by two unpacked pieces when some two fill the gap it leaves more tightly.

The fill is decided on the number of pieces of each length: there are at most
`length` lengths, so the plan (patterns of lengths and how often each is
used) stays small for any corpus. Pieces find their place from their rank
among the pieces of their length, which is counted per task and summed.

Defined cases: null and empty texts are one end id; repeated rows and repeated
or null ids are packed like others; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged
from .tokens import Encoder

END_ID = 2


def pieces_of(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids; all but the first have the full length."""
    if n <= length:
        return [(0, n)]
    head = n % length
    return ([(0, head)] if head else []) + [(i, length) for i in range(head, n, length)]


def best_two_fit(counts: dict[int, int], length: int) -> list[tuple[list[int], int]]:
    """Counts of pieces per length -> [(lengths of one sequence, number of such sequences)]."""
    left = {k: n for k, n in counts.items() if n > 0}
    keys = sorted(left)
    out: list[tuple[list[int], int]] = []

    def spend(k: int, n: int) -> None:
        left[k] -= n
        if not left[k]:
            del left[k]
            keys.remove(k)

    while keys:
        used: dict[int, int] = {}
        gap, bin_ = length, []

        def free(k: int) -> int:
            return left.get(k, 0) - used.get(k, 0)

        while True:
            i = bisect_right(keys, gap) - 1
            while i >= 0 and free(keys[i]) <= 0:
                i -= 1
            if i < 0:
                break
            k = keys[i]
            bin_.append(k)
            used[k] = used.get(k, 0) + 1
            gap -= k
        if gap and len(bin_) > 1:
            small = min(bin_)
            room = gap + small
            used[small] -= 1
            best, pair = small, None
            low, high = 0, bisect_right(keys, room) - 1
            while low <= high:
                a, b = keys[low], keys[high]
                if a + b > room:
                    high -= 1
                elif free(a) < 1 or (a == b and free(a) < 2):
                    low += 1
                elif free(b) < 1:
                    high -= 1
                else:
                    if a + b > best:
                        best, pair = a + b, (a, b)
                    low += 1
            if pair:
                bin_.remove(small)
                bin_ += pair
                for k in pair:
                    used[k] = used.get(k, 0) + 1
            else:
                used[small] += 1
        times = min(left[k] // n for k, n in used.items() if n)
        out.append((sorted(bin_, reverse=True), times))
        for k, n in used.items():
            if n:
                spend(k, n * times)
    return out


def places(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset), by rank."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for k in lengths:
            table.setdefault(k, []).append((ranks.get(k, 0), sequence, offset))
            ranks[k] = ranks.get(k, 0) + times
            offset += k
        sequence += times
    return {k: np.array(v, np.int64) for k, v in table.items()}


def tokenized(docs: DataFrame, vocabulary: str, length: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: key, piece, start, length, ids_crc32, task, seat (rank among the task's pieces of that length)."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        from pyspark import TaskContext

        encoder, task, seats = Encoder(vocabulary), TaskContext.get().partitionId(), {}
        for pdf in batches:
            rows = []
            for at, text_ in enumerate(pdf["text"]):
                ids = np.append(encoder.ids(text_), np.uint32(END_ID)).astype("<u4")
                for piece, (start, n) in enumerate(pieces_of(len(ids), length)):
                    seat = seats.get(n, 0)
                    seats[n] = seat + 1
                    rows.append((at, piece, start, n, zlib.crc32(ids[start : start + n].tobytes()), task, seat))
            table = np.array(rows, np.int64).reshape(-1, 7)
            out = pd.DataFrame(table[:, 1:], columns=["piece", "start", "length", "ids_crc32", "task", "seat"])
            out.insert(0, "key", pdf["key"].array.take(table[:, 0]))
            yield out

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, piece int, start long, length long, ids_crc32 long, task int, seat long")


def pack(docs: DataFrame, vocabulary: str, length: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    cut = staged(tokenized(docs, vocabulary, length, key, text), "pieces")
    per = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    # At most `length` rows, whatever the corpus.
    counts = {int(r["length"]): int(r["n"]) for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(best_two_fit(counts, length))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = per.select("task", "length", base.alias("base"))

    def place(batches):
        for pdf in batches:
            n, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            order = np.argsort(n, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
                if not len(rows):
                    continue
                t = table[int(n[rows[0]])]
                hit = np.searchsorted(t[:, 0], rank[rows], side="right") - 1
                sequence[rows] = t[hit, 1] + rank[rows] - t[hit, 0]
                offset[rows] = t[hit, 2]
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    ranked = cut.join(bases, ["task", "length"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("seat") + F.col("base")).alias("rank"))
    kind = dict(docs.dtypes)[key]
    return ranked.mapInPandas(place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("key", key)
