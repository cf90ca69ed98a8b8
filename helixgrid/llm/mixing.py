"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size within each source. A source whose target
is q whole times its size and a rest R takes every document q times; the rest
is a subset whose sizes should sum to R. Its bulk is the same share of every
size; what is left of the budget is fitted by a bounded knapsack over the
sizes that still have documents, so the error is at most half the size of the
smallest document left out (a nearer sum would take it). Within a size, documents are chosen in the
order of a seeded hash of their id and text, so reruns agree, and rows that share an
id, or have none, are dealt by their texts.

The knapsack runs on counts per (source, size), never on documents, in one
task per source. Choosing the documents of a size is dealt into buckets by
the leading part of the hash: whole buckets are taken while they fit, and
only the bucket where the count ends is ordered.

Defined cases: null text has size zero and takes nothing; a null source is a
source of its own, last in order; repeated rows and null ids are chosen like
others (equal rows are interchangeable); very long texts are counted whole by
one expression; further columns, whatever their names, are not read;
an empty table gives an empty result; sources without a word have target 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, staged

WEIGHTS = (3, 1, 2)
#: Words of remaining budget that the knapsack fits; up to as many in all it works alone.
EXACT = 1 << 16
#: Rows of one size and source that are ordered together.
BUCKET = 512


def fit_targets(sizes: list[int], weights: list[int], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Splits share * total by weight; no target is over `most` times its source, the excess goes to the others by weight."""
    target = [0.0] * len(sizes)
    open_, rest = [i for i, n in enumerate(sizes) if n > 0], share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = rest * weights[i] / total
            break
        for i in full:
            target[i] = most * sizes[i]
        rest -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def subset_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their sum comes as near to the budget as can be.

    sizes ascending and positive. Up to EXACT words in all, the knapsack decides alone and the result is the
    best there is. Above, the proportional and greedy parts leave a small budget; the bounded knapsack (counts
    split in powers of two, reachable sums as bits of one integer) fits that with the documents left.
    """
    sizes, counts = sizes.astype(object), counts.astype(object)
    total = int((sizes * counts).sum()) if len(sizes) else 0
    if not len(sizes) or budget <= 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    take = np.zeros(len(sizes), object)
    rest = budget
    if total > EXACT:
        take += np.array([int(c) * budget // total for c in counts], object)
        rest -= int((sizes * take).sum())
        for i in range(len(sizes) - 1, -1, -1):
            # Largest first, as long as the knapsack has small documents left to end with.
            more = min(int(counts[i] - take[i]), max(0, rest - EXACT // 2) // int(sizes[i]))
            take[i] += more
            rest -= more * int(sizes[i])
        # Give some of each size back, so that the knapsack can also choose otherwise.
        room = EXACT - rest
        for i in range(len(sizes)):
            back = min(int(take[i]), 2)
            if back and back * int(sizes[i]) <= room // 8:
                take[i] -= back
                rest += back * int(sizes[i])
                room -= back * int(sizes[i])
    full = (1 << (rest + int(sizes[-1]) + 1)) - 1
    reach, parts = 1, []
    for i in range(len(sizes) - 1, -1, -1):
        n, k = min(int(counts[i] - take[i]), rest // int(sizes[i]) + 1), 1
        while n > 0:
            k = min(k, n)
            grown = (reach | reach << (k * int(sizes[i]))) & full
            if grown != reach:
                parts.append((i, k, reach))
                reach = grown
            n -= k
            k *= 2
        if reach >> rest & 1:
            break
    low, high = (reach & (1 << (rest + 1)) - 1).bit_length() - 1, reach >> rest
    over = (high & -high).bit_length() - 1 if high else -1
    at = rest + over if 0 <= over < rest - low else low
    for i, k, before in reversed(parts):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(sizes[i])
    return take.astype(np.int64)


def measured(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, tie (a hash of the text), size (words)."""
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("tie"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, size, source_size, target, times (how often the mix takes the document), taken (size * times)."""
    rows = staged(measured(docs, key, source, text), "sizes")
    counts = staged(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    # One row per source reaches the driver; sources are few by nature.
    totals = [(r["source"], int(r["words"])) for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words")).collect()]
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    target = fit_targets([n for _, n in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)
    spark = docs.sparkSession
    plan_of = spark.createDataFrame([(s, n, t) for (s, n), t in zip(totals, target, strict=True)], "source string, source_size long, target double")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        words, goal = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = int(goal // words) if words else 0
        budget = round(goal) - whole * words
        some = pdf["size"].to_numpy() > 0
        more = np.zeros(len(pdf), np.int64)
        more[some] = subset_counts(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], budget)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "source_size": pdf["source_size"], "target": pdf["target"], "whole": whole, "more": more})

    by_source = counts.join(F.broadcast(plan_of), counts["source"].eqNullSafe(plan_of["source"])).select(counts["source"], "size", "n", "source_size", "target")
    plan = staged(by_source.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, whole long, more long"), "plan")
    p = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "source_size", "target", "whole", "more")
    drawn = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("key"), F.col("tie")))
    rated = drawn.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size")
    rated = rated.withColumn("bucket", F.when((F.col("more") > 0) & (F.col("more") < F.col("n")), F.pmod(F.col("draw"), F.ceil(F.col("n") / F.lit(BUCKET)))))
    sure = rated.where("bucket is null").withColumn("extra", (F.col("more") > 0).cast("long"))
    open_ = rated.where("bucket is not null")
    per = open_.groupBy("source", "size", "bucket", "more").agg(F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = per.withColumn("left", F.greatest(F.lit(0), F.least(F.col("here"), F.col("more") - before))).select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), "here", "left")
    seated = open_.join(left, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket"))).drop("b_source", "b_size", "b_bucket")
    clear = seated.where("left = 0 or left = here").withColumn("extra", (F.col("left") > 0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", "key"))
    ranked = seated.where("left > 0 and left < here").withColumn("extra", (rank <= F.col("left")).cast("long"))
    columns = ["key", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("times")]
    out = sure.select(*columns).union(clear.select(*columns)).union(ranked.select(*columns))
    return out.withColumn("times", F.when(F.col("size") == 0, 0).otherwise(F.col("times")).cast("long")).withColumn("taken", F.col("size") * F.col("times")).withColumnRenamed("key", key)
