"""Counting words, and filters and reports on counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import counted_codes
from .packed import SHORT_K, packed_counts
from .windows import explode_windows, window_summary

#: The largest count that the binary table format holds.
CEILING = 4_294_967_295


class CountOverflow(ValueError):
    """A count passed the ceiling where that is an error."""


def count_words(df: DataFrame, k: int, canonical: bool = False, seq: str = "seq") -> DataFrame:
    """kmer, count over all sequences.

    Short words are counted as codes, partial counts combined before the shuffle; longer ones travel as stretches
    of bases (see packed).
    """
    if k <= SHORT_K:
        return counted_codes(df, k, canonical, seq)
    return packed_counts(df, k, canonical, seq)


def exploded_counts(df: DataFrame, k: int, canonical: bool = False, seq: str = "seq") -> DataFrame:
    """As count_words, for any k, a row for each window and without Python."""
    return explode_windows(df, k, canonical, seq).groupBy("kmer").agg(F.count("*").alias("count"))


def file_report(sequences: DataFrame, k: int, seq: str = "seq", file: str = "file") -> DataFrame:
    """file, records, emitted, skipped: what each input file gives to a count."""
    per = window_summary(sequences, k, seq, (file,))
    return per.groupBy(file).agg(F.count("*").alias("records"), F.sum("emitted").alias("emitted"), F.sum("skipped").alias("skipped"))


def check_bounds(least: int | None = None, most: int | None = None) -> None:
    if least is not None and least < 0:
        raise ValueError("the least count must not be negative")
    if most is not None and most <= 0:
        raise ValueError("the largest count must be positive")
    if least is not None and most is not None and least > most:
        raise ValueError(f"the least count {least} is over the largest {most}")


def in_bounds(least: int | None = None, most: int | None = None, count: str = "count") -> Column:
    """Inclusive bounds, each optional."""
    check_bounds(least, most)
    test = F.lit(True)
    if least is not None:
        test = test & (F.col(count) >= least)
    if most is not None:
        test = test & (F.col(count) <= most)
    return test


def filter_counts(counts: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    return counts.where(in_bounds(least, most))


def filter_report(counts: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """total_before, unique_before, kept_after, filtered_out, kept_percentage (100 where there is nothing)."""
    kept = F.count_if(in_bounds(least, most))
    every = F.count("*")
    share = F.when(every == 0, F.lit(100.0)).otherwise(100.0 * kept / every)
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_before"), every.alias("unique_before"), kept.alias("kept_after"), (every - kept).alias("filtered_out"), share.alias("kept_percentage"))


def top_words(counts: DataFrame, n: int) -> DataFrame:
    """The n largest counts, ties by word."""
    return counts.orderBy(F.desc("count"), "kmer").limit(n)


def counter_report(counts: DataFrame, k: int, canonical: bool) -> DataFrame:
    """total, unique, k, canonical, and the bytes a dense table of that many rows would take."""
    key = 8 if k <= 32 else 16
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_kmers"), F.count("*").alias("unique_kmers"), (F.count("*") * (24 + key + 4)).alias("memory_bytes")).withColumn("k", F.lit(k)).withColumn("canonical", F.lit(canonical))


def capped(count: Column, policy: str = "exact") -> Column:
    """Sums: 'exact' keeps them, 'saturate' stops at the ceiling of the binary format, 'error' fails the job beyond it."""
    if policy == "exact":
        return count
    if policy == "saturate":
        return F.least(count, F.lit(CEILING))
    if policy == "error":
        return F.when(count <= CEILING, count).otherwise(F.raise_error(F.lit(f"a count passed {CEILING}")).cast("long"))
    raise ValueError(f"unknown policy {policy!r}")
