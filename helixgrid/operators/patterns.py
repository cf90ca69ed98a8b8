"""Prefix, suffix and gapped patterns as predicates.

A pattern's fixed beginning is always written as startswith, which Parquet
readers can use on sorted tables; LIKE with a wildcard inside is not pushed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many words a wildcard query is listed out; beyond it the table is scanned.
LISTED = 16


class PatternError(ValueError):
    """A pattern that cannot be read or does not fit the table's k."""


def bases_only(text: str, what: str = "pattern") -> str:
    out = text.strip().upper()
    if not re.fullmatch("[ACGT]+", out):
        raise PatternError(f"{what} must be one or more of A, C, G, T: {text!r}")
    return out


@dataclass(frozen=True)
class GapPattern:
    """prefix, a gap of any bases, suffix: 'AC{N3}GT'. A gap of None stands for no braces: any word with the prefix."""

    prefix: str
    gap: int | None
    suffix: str

    @property
    def length(self) -> int:
        return len(self.prefix) + (self.gap or 0) + len(self.suffix)


def parse_gap(text: str) -> GapPattern:
    """The first {..} is the gap: {N} is one base, {Nn} n; no braces: a plain prefix."""
    text = text.strip().upper()
    head, brace, rest = text.partition("{")
    if not brace:
        if "N" in text:
            raise PatternError(f"write N inside braces: {text!r}")
        return GapPattern(bases_only(text), None, "")
    inside, close, tail = rest.partition("}")
    m = re.fullmatch(r"N(\d*)", inside)
    if not close or not m:
        raise PatternError(f"the gap must be {{N}} or {{Nn}}: {text!r}")
    for part in (head, tail):
        if part:
            bases_only(part)
    return GapPattern(head, int(m[1] or 1), tail)


def starts(prefix: str, k: int) -> Column:
    """Words with a prefix; it must be shorter than k."""
    prefix = bases_only(prefix, "prefix")
    if len(prefix) >= k:
        raise PatternError(f"a prefix must be shorter than {k}")
    return F.col("kmer").startswith(prefix)


def starts_loosely(prefix: str, k: int) -> Column:
    """As starts, but empty or too long prefixes match nothing and a whole word is allowed."""
    prefix = prefix.strip().upper()
    if not prefix or len(prefix) > k:
        return F.lit(False)
    return F.col("kmer").startswith(bases_only(prefix, "prefix"))


def ends(suffix: str, k: int) -> Column:
    suffix = bases_only(suffix, "suffix")
    if len(suffix) >= k:
        raise PatternError(f"a suffix must be shorter than {k}")
    return F.col("kmer").endswith(suffix)


def gapped(pattern: GapPattern | str, k: int) -> Column:
    """Words of a gap pattern, which covers k bases; a gap of no bases is a gap like others. Without braces the prefix alone decides."""
    p = parse_gap(pattern) if isinstance(pattern, str) else pattern
    if p.gap is None:
        return starts_loosely(p.prefix, k)
    if p.length != k:
        raise PatternError(f"the pattern covers {p.length} bases, the table has {k}")
    test = F.lit(True)
    if p.prefix:
        test = test & F.col("kmer").startswith(p.prefix)
    if p.suffix:
        test = test & F.col("kmer").endswith(p.suffix)
    return test


def wildcard(pattern: str, k: int) -> Column:
    """Words where N stands for any base anywhere; the fixed beginning is pushed down."""
    pattern = pattern.strip().upper()
    if len(pattern) != k or not re.fullmatch("[ACGTN]+", pattern):
        raise PatternError(f"a wildcard pattern has {k} of A, C, G, T, N: {pattern!r}")
    head = pattern.split("N", 1)[0]
    test = F.col("kmer").startswith(head) if head else F.lit(True)
    return test & F.col("kmer").like(pattern.replace("N", "_")) if "N" in pattern else F.col("kmer") == pattern


def strategy(pattern: str) -> str:
    """How a wildcard pattern is best answered: exact, listed, prefix, suffix, gapped or scan."""
    pattern = pattern.strip().upper()
    n = pattern.count("N")
    if not n:
        return "exact"
    if 4**n <= LISTED:
        return "listed"
    if re.fullmatch("[ACGT]+N+", pattern):
        return "prefix"
    if re.fullmatch("N+[ACGT]+", pattern):
        return "suffix"
    if re.fullmatch("[ACGT]+N+[ACGT]+", pattern):
        return "gapped"
    return "scan"


def explain_pattern(spark: SparkSession, pattern: str) -> DataFrame:
    """pattern, strategy, wildcards, words it stands for."""
    n = pattern.upper().count("N")
    return spark.createDataFrame([(pattern, strategy(pattern), n, float(4**n))], "pattern string, strategy string, wildcards int, words double")


def multi_prefix(table: DataFrame, prefixes: list[str], k: int) -> DataFrame:
    """prefix, kmer, count for each prefix that matches: one pass, an equality join per prefix length."""
    asked = sorted({p.strip().upper() for p in prefixes if p.strip()})
    lengths = sorted({len(p) for p in asked if len(p) <= k})
    if not lengths:
        return table.select(F.lit("").alias("prefix"), "kmer", "count").limit(0)
    spark = table.sparkSession
    tried = table.withColumn("prefix", F.explode(F.array(*[F.substring("kmer", 1, n) for n in lengths])))
    wanted = spark.createDataFrame([(p,) for p in asked if len(p) <= k], "prefix string")
    return tried.join(F.broadcast(wanted) if len(asked) <= 100_000 else wanted, "prefix").select("prefix", "kmer", "count")


def prefix_block(table: DataFrame, prefix: str, k: int) -> DataFrame:
    """start and end: the half-open range of rows that a prefix takes in the sorted table."""
    p = bases_only(prefix, "prefix")
    lo, hi = p.ljust(k, "A"), p.ljust(k, "T")
    return table.agg(F.count_if(F.col("kmer") < lo).alias("start"), F.count_if(F.col("kmer") <= hi).alias("end"))
