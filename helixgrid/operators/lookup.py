"""Exact lookups: one word, many words, every window of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import ascii_upper, reverse_complement
from .windows import placed_windows


def key_of(word: Column, canonical: bool) -> Column:
    """What a word is stored under."""
    up = ascii_upper(word)
    return F.least(up, reverse_complement(up)) if canonical else up


def lookup_words(table: DataFrame, words: DataFrame, canonical: bool, word: str = "kmer") -> DataFrame:
    """words with count and found; missing ones have 0, repeated ones stay. One join, no size is assumed."""
    asked = words.withColumn("_key", key_of(F.col(word), canonical))
    hit = table.select(F.col("kmer").alias("_key"), F.col("count").alias("_count"))
    return asked.join(hit, "_key", "left").withColumn("count", F.coalesce("_count", F.lit(0))).withColumn("found", F.col("count") > 0).drop("_key", "_count")


def lookup_sequences(table: DataFrame, sequences: DataFrame, k: int, canonical: bool, seq: str = "seq", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """record, pos, kmer, count for every window in place; windows with ambiguous bases count 0, letters stay as they are."""
    placed = placed_windows(sequences, k, seq, keep)
    clean = F.when(ascii_upper(F.col("kmer")).rlike("^[ACGT]+$"), key_of(F.col("kmer"), canonical))
    asked = placed.withColumn("_key", clean)
    hit = table.select(F.col("kmer").alias("_key"), F.col("count").alias("_count"))
    return asked.join(hit, "_key", "left").select(*keep, "pos", "kmer", F.coalesce("_count", F.lit(0)).alias("count"))


def missing_windows(table: DataFrame, sequences: DataFrame, k: int, canonical: bool, seq: str = "seq", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """record, zero_windows: distinct windows of a sequence that the table lacks. Records without any have 0."""
    from .windows import explode_windows

    own = explode_windows(sequences, k, canonical, seq, keep).distinct()
    absent = own.join(table.select("kmer"), "kmer", "left_anti").groupBy(*keep).agg(F.count("*").alias("zero_windows"))
    return sequences.select(*keep).distinct().join(absent, list(keep), "left").select(*keep, F.coalesce("zero_windows", F.lit(0)).alias("zero_windows"))
