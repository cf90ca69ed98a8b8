"""Statistics over a table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmptyTable(ValueError):
    """Statistics of a table without rows."""


def summary(counts: DataFrame, approximate: bool = False, strict: bool = False) -> DataFrame:
    """total_kmers (sum), unique_kmers (rows), min, max, mean and median of the counts.

    strict: a table without rows is an error instead of a row of nulls.
    """
    middle = F.percentile_approx("count", 0.5, 10_000).cast("double") if approximate else F.percentile("count", 0.5)
    out = counts.agg(
        F.sum("count").alias("total_kmers"), F.count("*").alias("unique_kmers"), F.min("count").alias("min_count"), F.max("count").alias("max_count"),
        (F.sum("count") / F.count("*")).alias("mean_count"), middle.alias("median_count"),
    )
    if strict and counts.isEmpty():
        raise EmptyTable("the table has no rows")
    return out


#: Bins that one row lists while they are filled.
FILL = 65_536


def histogram(counts: DataFrame, fill: bool = True, most_bins: int | None = None) -> DataFrame:
    """count -> frequency, zero-filled from the smallest count to the largest.

    Every count has its bin, so frequencies add up to the number of words; with most_bins the bin of that
    number holds all larger counts too. Without fill, only bins that occur have a row.
    """
    bin_ = F.col("count") if most_bins is None else F.least(F.col("count"), F.lit(most_bins).cast("long"))
    found = counts.groupBy(bin_.alias("count")).agg(F.count("*").alias("frequency"))
    if not fill:
        return found
    ends = found.agg(F.min("count").alias("lo"), F.max("count").alias("hi")).where("lo is not null")
    blocks = ends.select("hi", F.explode(F.sequence("lo", "hi", F.lit(FILL).cast("long"))).alias("start"))
    bins = blocks.select(F.explode(F.sequence("start", F.least("hi", F.col("start") + (FILL - 1)))).alias("count"))
    return bins.join(found, "count", "left").select("count", F.coalesce("frequency", F.lit(0)).alias("frequency"))


PERCENTILES = (25, 50, 75, 90, 95, 99)


#: Counts of one class share their length in bits and the HEAD bits after the first one.
HEAD = 6


def _class(count):
    """A number of at most 64 * 2^HEAD values that rises with the count."""
    bits = F.length(F.bin(count))
    return bits * (1 << HEAD) + F.expr(f"shiftright(count, greatest(length(bin(count)) - {HEAD + 1}, 0))").bitwiseAND(F.lit((1 << HEAD) - 1))


def percentiles(counts: DataFrame) -> DataFrame:
    """p25 to p99 as the element at place floor(n*q/100) in sorted order; p50 is the integer mean of the middle two for even n.

    Places are found on the cumulative histogram, not by sorting the rows. Distinct counts are ranked inside
    their class; only the classes, 4096 at most, are summed up in one task and sent to all others.
    """
    from pyspark.sql.window import Window

    found = counts.groupBy("count").agg(F.count("*").alias("n")).withColumn("class", _class(F.col("count")))
    per = found.groupBy("class").agg(F.sum("n").alias("_in"))
    upto = F.sum("_in").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    offsets = per.select("class", (upto - F.col("_in")).alias("_before"), F.sum("_in").over(Window.partitionBy()).alias("all"))
    inside = F.sum("n").over(Window.partitionBy("class").orderBy("count").rowsBetween(Window.unboundedPreceding, 0))
    run = found.withColumn("_upto", inside).join(F.broadcast(offsets), "class").withColumn("end", F.col("_before") + F.col("_upto"))
    start = F.col("end") - F.col("n")

    def at(place):
        return F.max(F.when((start <= place) & (place < F.col("end")), F.col("count")))

    total = F.col("all")
    aggs = []
    for q in PERCENTILES:
        if q == 50:
            low, high = at(F.floor((total - 1) / 2)), at(F.floor(total / 2))
            aggs.append(F.floor((low + high) / 2).cast("long").alias("median"))
        else:
            aggs.append(at(F.least(F.floor(total * q / 100), total - 1)).alias(f"p{q}"))
    return run.agg(*aggs)
