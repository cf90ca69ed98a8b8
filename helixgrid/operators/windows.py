"""Windows of k bases as rows.

A sequence is split into its runs of bases, runs into blocks of at most BLOCK
windows, blocks into windows. The reverse complement is made once per block,
not per window, and blocks are sliced as bytes, so the cost of a window does
not depend on where it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import ascii_upper, check_k, extractable, reverse_complement, runs, usable

BLOCK = 2048


def _word(block: str, start: Column, k: int) -> Column:
    return F.substring(F.col(block), start, F.lit(k)).cast("string")


def explode_windows(df: DataFrame, k: int, canonical: bool = False, seq: str = "seq", keep: tuple[str, ...] = (), alias: str = "kmer") -> DataFrame:
    """One row per window without an ambiguous base; keep: columns that go along."""
    check_k(k)
    cut = df.select(*keep, F.explode(runs(F.col(seq))).alias("_run")).where(F.length("_run") >= k)
    return _cut_blocks(cut, k, canonical, keep, alias)


def _cut_blocks(cut: DataFrame, k: int, canonical: bool, keep: tuple[str, ...], alias: str) -> DataFrame:
    n = F.length("_run")
    blocks = cut.withColumn("_at", F.explode(F.sequence(F.lit(1), n - (k - 1), F.lit(BLOCK))))
    piece = F.substring(F.col("_run").cast("binary"), F.col("_at"), F.lit(BLOCK + k - 1))
    columns = [piece.alias("_fwd")]
    if canonical:
        columns.append(reverse_complement(piece.cast("string")).cast("binary").alias("_rev"))
    pieces = blocks.select(*keep, *columns).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_fwd") - (k - 1))))
    word = _word("_fwd", F.col("_i"), k)
    if canonical:
        word = F.least(word, _word("_rev", F.length("_fwd") - F.col("_i") - (k - 2), k))
    return pieces.select(*keep, word.alias(alias))


def strict_windows(df: DataFrame, k: int, canonical: bool = False, seq: str = "seq", keep: tuple[str, ...] = (), alias: str = "kmer") -> DataFrame:
    """Windows of the sequences that have no ambiguous base at all; others and short ones give none."""
    check_k(k)
    cut = df.where(usable(F.col(seq), k)).select(*keep, ascii_upper(F.col(seq)).alias("_run"))
    return _cut_blocks(cut, k, canonical, keep, alias)


def placed_windows(df: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = ("record_id",), alias: str = "kmer") -> DataFrame:
    """Every window in its place (pos from 0), also those with ambiguous bases; letters as they stand."""
    check_k(k)
    rows = df.where(F.length(seq) >= k).select(*keep, F.col(seq).alias("_seq"))
    blocks = rows.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_seq") - (k - 1), F.lit(BLOCK))))
    pieces = blocks.select(*keep, "_at", F.substring(F.col("_seq"), F.col("_at"), F.lit(BLOCK + k - 1)).alias("_piece"))
    return pieces.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_piece") - (k - 1)))).select(*keep, (F.col("_at") + F.col("_i") - 2).cast("long").alias("pos"), F.substring(F.col("_piece"), F.col("_i"), F.lit(k)).alias(alias))


def window_summary(df: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """emitted and skipped windows of each sequence, by arithmetic on run lengths."""
    check_k(k)
    emitted = extractable(F.col(seq), k)
    every = F.greatest(F.length(seq) - (k - 1), F.lit(0)).cast("long")
    return df.select(*keep, emitted.alias("emitted"), (every - emitted).alias("skipped"))
