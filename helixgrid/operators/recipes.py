"""Composite queries on assemblies: support, gaps and their filling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import ascii_upper, polymers
from .lookup import key_of
from .windows import placed_windows


#: Bases of a record that are marked at once.
STRETCH = 1 << 14


def mark_unsupported(table: DataFrame, sequences: DataFrame, k: int, canonical: bool, seq: str = "seq", key: str = "record_id") -> DataFrame:
    """record, length, supported, marked, trimmed, percent: bases under no window of the table become N.

    Records are judged in stretches of bounded size, so a long record is spread over tasks; the starts of
    supported windows meet the stretch they cover (a window over a seam meets both), and only the marked
    stretches of a record are put together. Records are known by their key, which must be unique; a null
    sequence counts as empty.
    """
    clean = F.coalesce(F.regexp_replace(F.col(seq), "[^ACGTacgt]", "N"), F.lit(""))
    rows = sequences.select(key, clean.alias("_seq"))
    placed = placed_windows(rows, k, "_seq", (key,))
    word = ascii_upper(F.col("kmer"))
    good = placed.where(~word.contains("N")).select(key, "pos", key_of(F.col("kmer"), canonical).alias("_key"))
    hit = good.join(table.select(F.col("kmer").alias("_key")), "_key", "left_semi").select(key, "pos")
    first, last = F.floor(F.col("pos") / STRETCH), F.floor((F.col("pos") + (k - 1)) / STRETCH)
    starts = hit.select(key, "pos", F.explode(F.sequence(first, last)).alias("_b")).groupBy(key, "_b").agg(F.collect_list((F.col("pos") - F.col("_b") * STRETCH).cast("int")).alias("_at"))
    body = F.substring(F.col("_seq").cast("binary"), (F.col("_b") * STRETCH + 1).cast("int"), F.lit(STRETCH))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.length("_seq") - 1, F.lit(0)) / STRETCH))
    pieces = rows.select(key, "_seq", F.explode(blocks).alias("_b")).select(key, "_b", body.alias("_p"))
    kind = dict(rows.dtypes)[key]
    names = {key: "_k", "_b": "_b", "_p": "_p", "_at": "_at"}

    def mark(batches):
        for pdf in batches:
            marked, supported = [], []
            for piece, at in zip(pdf["_p"], pdf["_at"], strict=True):
                n = len(piece)
                change = np.zeros(n + 1, np.int32)
                if at is not None:
                    at = np.asarray(at, np.int64)
                    np.add.at(change, np.maximum(at, 0), 1)
                    np.add.at(change, np.minimum(at + k, n), -1)
                under = np.cumsum(change[:n]) > 0
                marked.append(np.where(under, np.frombuffer(piece, np.uint8), ord("N")).astype(np.uint8).tobytes().decode())
                supported.append(int(under.sum()))
            yield pd.DataFrame({"_k": pdf["_k"], "_b": pdf["_b"], "_m": marked, "_s": supported})

    both = pieces.join(starts, [key, "_b"], "left").select(*[F.col(c).cast("string").alias(a) if c == key else F.col(c).alias(a) for c, a in names.items()])
    done = both.mapInPandas(mark, "_k string, _b long, _m string, _s long")
    whole = done.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_b", "_m"))).alias("_parts"), F.sum("_s").alias("supported"))
    marked = whole.select(F.col("_k").cast(kind).alias(key), F.array_join(F.col("_parts._m"), "").alias("marked"), "supported").withColumn("length", F.length("marked"))
    percent = F.when(F.col("length") > 0, 100.0 * F.col("supported") / F.col("length")).otherwise(F.lit(0.0))
    return marked.select(key, "length", "supported", "marked", F.trim("marked", F.lit("N")).alias("trimmed"), percent.alias("percent"))


def flank_pattern(sequence: str, first: int, last: int, k: int) -> tuple[str, int, str] | None:
    """(left flank, gap, right flank) that centre the gap first..last (inclusive) in a window of k; None where flanks lack."""
    gap = last - first + 1
    rest = k - gap
    if rest < 2:
        return None
    left = rest // 2
    right = rest - left
    a, b = sequence[max(0, first - left) : first], sequence[last + 1 : last + 1 + right]
    if len(a) < left or len(b) < right or "N" in a + b:
        return None
    return a.upper(), gap, b.upper()


def flanks(sequences: DataFrame, k: int, seq: str = "seq", key: str = "record_id") -> DataFrame:
    """key, first, last, prefix, gap, suffix for every gap of a record that a window of k can centre; see flank_pattern."""
    from ..functions.sequence import gaps

    rows = sequences.select(key, F.col(seq).alias("_s"), F.explode(gaps(F.col(seq))).alias("_g")).select(key, "_s", F.col("_g.first").alias("first"), F.col("_g.last").alias("last"))
    rest = rows.withColumn("gap", F.col("last") - F.col("first") + 1).withColumn("_n", k - F.col("gap")).where("_n >= 2").withColumn("_l", F.floor(F.col("_n") / 2).cast("int"))
    whole = rest.where("first >= _l").withColumn("prefix", F.upper(F.substring(F.col("_s"), F.col("first") - F.col("_l") + 1, F.col("_l")))).withColumn("suffix", F.upper(F.substring(F.col("_s"), F.col("last") + 2, F.col("_n") - F.col("_l"))))
    good = whole.where((F.length("suffix") == F.col("_n") - F.col("_l")) & ~F.concat("prefix", "suffix").contains("N"))
    return good.select(key, "first", "last", "prefix", "gap", "suffix")


def gap_candidates(table: DataFrame, regions: DataFrame) -> DataFrame:
    """regions: region, prefix, suffix -> region, kmer, count, polymers of the words that fit.

    The join is on the prefix's first bases, so regions of any number meet the table by equality.
    """
    keyed = regions.withColumn("_n", F.length("prefix"))
    lengths = [r["_n"] for r in keyed.select("_n").distinct().orderBy("_n").collect()]  # at most k of them
    if not lengths:
        return table.select(F.lit(None).cast("string").alias("region"), "kmer", "count", polymers(F.col("kmer")).alias("polymers")).limit(0)
    tried = table.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lengths]))).withColumn("prefix", F.substring(F.col("kmer"), F.lit(1), F.col("_n")))
    fit = tried.join(keyed, ["_n", "prefix"]).where(F.col("kmer").endswith(F.col("suffix")))
    return fit.select("region", "kmer", "count", polymers(F.col("kmer")).alias("polymers"))


def choose_fill(candidates: DataFrame, by_polymers: bool = False) -> DataFrame:
    """For each region the word of the largest count, or of the fewest polymers and then the largest count; ties by word."""
    # A minimum over a struct is combined before the shuffle, where a ranking window would not be.
    c = (-F.col("count")).alias("c")
    best = F.min(F.struct("polymers", c, "kmer") if by_polymers else F.struct(c, "polymers", "kmer"))
    return candidates.groupBy("region").agg(best.alias("b")).select("region", "b.kmer", (-F.col("b.c")).alias("count"), "b.polymers")


def polish(table: DataFrame, candidates: DataFrame, regions: DataFrame, k: int, canonical: bool, most: int | None = None) -> DataFrame:
    """For each region the candidate that leaves the fewest distinct windows missing from the table.

    regions: region, left, right (context around the candidate). Every candidate is tried, or with `most` the
    best of each region by count.
    """
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("count"), "kmer"))
        candidates = candidates.withColumn("_r", rank).where(F.col("_r") <= most)
    tried = candidates.join(regions.select("region", "left", "right"), "region")
    from .windows import explode_windows

    built = tried.select("region", F.col("kmer").alias("fill"), F.col("count").alias("fill_count"), F.concat("left", "kmer", "right").alias("_seq"))
    own = explode_windows(built, k, canonical, "_seq", ("region", "fill", "fill_count")).distinct()
    absent = own.join(table.select("kmer", F.lit(1).alias("_in")), "kmer", "left").groupBy("region", "fill", "fill_count").agg(F.count_if(F.col("_in").isNull()).alias("zero_windows"))
    return absent.groupBy("region").agg(F.min(F.struct("zero_windows", (-F.col("fill_count")).alias("c"), "fill")).alias("b")).select("region", F.col("b.fill").alias("kmer"), (-F.col("b.c")).alias("count"), "b.zero_windows")
