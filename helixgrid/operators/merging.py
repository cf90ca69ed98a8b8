"""Merging tables of counts: bag union, sums by word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import canonical as canonical_of
from .counting import capped
from .packed import Source, packed_totals


def sum_tables(tables: list[DataFrame], policy: str = "exact") -> DataFrame:
    """kmer, count summed over all tables; the policy says what happens beyond the binary format's ceiling."""
    if not tables:
        raise ValueError("nothing to merge")
    every = reduce(DataFrame.unionByName, [t.select("kmer", "count") for t in tables])
    return every.groupBy("kmer").agg(F.sum("count").alias("_sum")).select("kmer", capped(F.col("_sum"), policy).alias("count"))


def merge_report(tables: list[DataFrame]) -> DataFrame:
    """inputs, rows_in, rows_out, shared (rows that met one of another table), total_kmers of a merge, in one pass."""
    if not tables:
        raise ValueError("nothing to merge")
    per = reduce(DataFrame.unionByName, [t.select("kmer", "count") for t in tables]).groupBy("kmer").agg(F.count("*").alias("n"), F.sum("count").alias("s"))
    rows_in = F.coalesce(F.sum("n"), F.lit(0))
    return per.agg(F.lit(len(tables)).alias("inputs"), rows_in.alias("rows_in"), F.count("*").alias("rows_out"), (rows_in - F.count("*")).alias("shared"), F.coalesce(F.sum("s"), F.lit(0)).alias("total_kmers"))


def packed_report(sources: list[list[Source]], k: int) -> DataFrame:
    """As merge_report, of tables of long words as what they are sums of (KmerTable.unsummed); each word of a table comes once."""
    every = packed_totals([s for table in sources for s in table], k)
    rows_in, rows_out, total = (F.coalesce(F.sum(c), F.lit(0)) for c in ("rows_in", "rows_out", "total"))
    return every.agg(F.lit(len(sources)).alias("inputs"), rows_in.alias("rows_in"), rows_out.alias("rows_out"), (rows_in - rows_out).alias("shared"), total.alias("total_kmers"))


def to_canonical(table: DataFrame) -> DataFrame:
    """The rows of a table under their canonical words (not summed yet)."""
    return table.select(canonical_of(F.col("kmer")).alias("kmer"), "count")


def intersect_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """An extra of this library: words of both, with the smaller count."""
    r = right.select("kmer", F.col("count").alias("_other"))
    return left.join(r, "kmer").select("kmer", F.least("count", "_other").alias("count"))


def subtract_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """An extra of this library: words of the first that the second lacks."""
    return left.join(right.select("kmer"), "kmer", "left_anti")
