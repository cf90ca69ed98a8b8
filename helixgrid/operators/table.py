"""A counted table with its metadata: k, canonical, sorted.

On disk a table is a folder with sorted Parquet in data/ and a metadata.json
beside it, both written through Spark, so any file system will do. Sorting by
range keeps a prefix in few row groups, and range bounds come from a sample of
the words, so frequent prefixes are split.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import check_k, hexadecimal
from . import counting, lookup, merging, packed, patterns, recipes, stats
from . import fuzzy as search

FORMAT = "1.0"


class TableError(ValueError):
    """Tables that are damaged, empty where that is an error, or do not fit together."""


def _row_sum(rows: DataFrame) -> F.Column:
    """An aggregate over rows that does not depend on their order: sums of three parts of their hashes, as no long holds the sum of all."""
    h, low = F.xxhash64(*rows.columns), F.lit((1 << 21) - 1)
    parts = (F.shiftright(h, 42), F.shiftright(h, 21).bitwiseAND(low), h.bitwiseAND(low))
    return F.struct(*[F.sum(p) for p in parts]).alias("rows")


def _digest(n: int, parts) -> str:
    total = None if parts[0] is None else (parts[0] << 42) + (parts[1] << 21) + parts[2]
    return hashlib.sha256(f"{n}:{total}".encode()).hexdigest()


def checksum(rows: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order or files."""
    r = rows.agg(F.count("*").alias("n"), _row_sum(rows)).first()
    return _digest(r["n"], r["rows"])


@dataclass(frozen=True)
class KmerTable:
    """rows: kmer STRING, count BIGINT, each word once."""

    rows: DataFrame
    k: int
    canonical: bool = False
    sorted: bool = False
    sources: tuple[str, ...] = ()
    custom: dict[str, str] = field(default_factory=dict)
    #: What gives the table when it is summed by word, and some of its words (packed.windows_like), where saving can do with these.
    parts: tuple[packed.Source, ...] = field(default=(), repr=False, compare=False)
    like: DataFrame | None = field(default=None, repr=False, compare=False)

    def __post_init__(self):
        check_k(self.k)

    # -- making ---------------------------------------------------------------------------------

    @classmethod
    def count(cls, sequences: DataFrame, k: int, canonical: bool = False, seq: str = "seq", least: int | None = None, most: int | None = None) -> KmerTable:
        rows = counting.count_words(sequences, k, canonical, seq)
        table = cls(counting.filter_counts(rows, least, most), k, canonical)
        if k <= packed.SHORT_K:
            return table
        parts = () if least or most else (packed.counted_source(sequences, k, canonical, seq),)
        return replace(table, parts=parts, like=packed.windows_like(sequences, k, canonical, seq))

    @classmethod
    def from_pairs(cls, spark: SparkSession, pairs: list[tuple[str, int]], k: int, canonical: bool = False) -> KmerTable:
        for word, _ in pairs:
            if len(patterns.bases_only(word, "a word")) != k:
                raise TableError(f"{word!r} does not have {k} bases")
        rows = spark.createDataFrame([(w.upper(), n) for w, n in pairs], "kmer string, count long")
        rows = rows.withColumn("kmer", lookup.key_of(F.col("kmer"), canonical)).groupBy("kmer").agg(F.sum("count").alias("count"))
        return cls(rows, k, canonical)

    @classmethod
    def empty(cls, spark: SparkSession, k: int, canonical: bool = False) -> KmerTable:
        return cls(spark.createDataFrame([], "kmer string, count long"), k, canonical, True)

    def add_sequences(self, sequences: DataFrame, seq: str = "seq") -> KmerTable:
        """This table with the words of more sequences; an overflow of a count is an error."""
        return self._with(merging.sum_tables([self.rows, counting.count_words(sequences, self.k, self.canonical, seq)], "error"))

    def add_word(self, word: str, count: int = 1) -> KmerTable:
        return self._with(merging.sum_tables([self.rows, KmerTable.from_pairs(self.spark, [(word, count)], self.k, self.canonical).rows], "error"))

    def _with(self, rows: DataFrame) -> KmerTable:
        return replace(self, rows=rows, sorted=False, parts=(), like=None)

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    # -- storing --------------------------------------------------------------------------------

    def save(self, path: str, allow_empty: bool = True, files: int | None = None) -> KmerTable:
        """Writes the table sorted by word; returns it as read again. Long words take one packed shuffle, also where they come from several tables."""
        if not allow_empty and self.rows.isEmpty():
            raise TableError("the table has no rows")
        if self.k > packed.SHORT_K:
            rows = packed.packed_in_order(self.unsummed(), self.k, packed.bounds_of(self._like(), files))
        else:
            rows = self.rows.select("kmer", "count")
            rows = (rows.repartitionByRange(files, "kmer") if files else rows.repartitionByRange("kmer")).sortWithinPartitions("kmer")
        # Sorted words share most of their letters with the one before, which this encoding leaves out.
        write = rows.write.mode("errorifexists").option("parquet.writer.version", "v2").option("parquet.enable.dictionary#kmer", "false").option("compression", "zstd")
        write.parquet(f"{path}/data")
        written = self.spark.read.schema("kmer string, count long").parquet(f"{path}/data")
        totals = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("s"), _row_sum(written)).first()
        meta = {"format": FORMAT, "k": self.k, "canonical": self.canonical, "sorted": True, "distinct_kmers": totals["n"], "total_kmers": totals["s"], "checksum": _digest(totals["n"], totals["rows"]), "created_at": int(time.time()), "source_files": list(self.sources), "custom": self.custom}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata.json")
        return KmerTable.load(self.spark, path)

    def unsummed(self) -> list[packed.Source]:
        """What gives the table when it is summed by word."""
        return list(self.parts) or [packed.table_source(self.rows, self.k)]

    def _like(self) -> DataFrame:
        return packed.rows_like(self.rows, self.k) if self.like is None else self.like

    @classmethod
    def load(cls, spark: SparkSession, path: str, check: bool = False) -> KmerTable:
        """Reads a saved table; check compares the number of rows and the checksum with the metadata."""
        meta = read_metadata(spark, path)
        rows = spark.read.schema("kmer string, count long").parquet(f"{path}/data")
        if check:
            found = rows.agg(F.count("*").alias("n"), _row_sum(rows)).first()
            if found["n"] != meta["distinct_kmers"]:
                raise TableError(f"{path} does not have the {meta['distinct_kmers']} rows of its metadata")
            if "checksum" in meta and _digest(found["n"], found["rows"]) != meta["checksum"]:
                raise TableError(f"the rows of {path} do not match its checksum")
        return cls(rows, meta["k"], meta["canonical"], meta["sorted"], tuple(meta["source_files"]), dict(meta["custom"]))

    # -- reading --------------------------------------------------------------------------------

    def get(self, word: str) -> int:
        """The count of one word, 0 if it is missing."""
        if len(patterns.bases_only(word, "a word")) != self.k:
            raise TableError(f"{word!r} does not have {self.k} bases")
        hit = self.rows.where(F.col("kmer") == lookup.key_of(F.lit(word.strip()), self.canonical)).select("count").head()
        return hit["count"] if hit else 0

    def exists(self, word: str) -> bool:
        return self.get(word) > 0

    def get_many(self, words: list[str]) -> dict[str, int]:
        """Counts of several words; a malformed word counts 0."""
        asked = self.spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "kmer string")
        return {r["kmer"]: r["count"] for r in self.lookup(asked).collect()}

    def lookup(self, words: DataFrame, word: str = "kmer") -> DataFrame:
        return lookup.lookup_words(self.rows, words, self.canonical, word)

    def lookup_sequences(self, sequences: DataFrame, seq: str = "seq", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
        return lookup.lookup_sequences(self.rows, sequences, self.k, self.canonical, seq, keep)

    def zero_windows(self, sequences: DataFrame, seq: str = "seq", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
        return lookup.missing_windows(self.rows, sequences, self.k, self.canonical, seq, keep)

    def prefix(self, prefix: str, least: int | None = None, most: int | None = None, loose: bool = False) -> DataFrame:
        test = patterns.starts_loosely(prefix, self.k) if loose else patterns.starts(prefix, self.k)
        return counting.filter_counts(self.rows.where(test), least, most)

    def prefixes(self, prefixes: list[str]) -> DataFrame:
        return patterns.multi_prefix(self.rows, prefixes, self.k)

    def prefix_block(self, prefix: str) -> DataFrame:
        return patterns.prefix_block(self.rows, prefix, self.k)

    def suffix(self, suffix: str) -> DataFrame:
        return self.rows.where(patterns.ends(suffix, self.k))

    def gapped(self, pattern: str) -> DataFrame:
        return self.rows.where(patterns.gapped(pattern, self.k))

    def wildcard(self, pattern: str) -> DataFrame:
        if patterns.strategy(pattern) == "listed" and len(pattern) == self.k:
            return self.rows.where(F.col("kmer").isin(search.expand_wildcards(pattern.strip().upper())))
        return self.rows.where(patterns.wildcard(pattern, self.k))

    def fuzzy(self, pattern: str, distance: int = 0, positions: str = "", limit: int = search.MAX_VARIANTS, beyond: str = "error") -> DataFrame:
        """Words that a query stands for; over its limit it is an error, or with beyond="scan" answered by a pass over the table."""
        q = search.FuzzyQuery(pattern.strip().upper(), self.k, distance, search.parse_positions(positions), limit)
        return search.search(self.rows, [q], beyond)

    def fuzzy_batch(self, patterns_: list[str], distance: int = 0, positions: str = "", limit: int = search.MAX_VARIANTS, fail_fast: bool = False) -> DataFrame:
        groups = search.parse_positions(positions)
        return search.search_batch(self.rows, [search.FuzzyQuery(p.strip().upper(), self.k, distance, groups, limit) for p in patterns_], fail_fast)

    def top(self, n: int) -> DataFrame:
        return counting.top_words(self.rows, n)

    def page(self, limit: int | None = None, offset: int = 0, as_hex: bool = False) -> DataFrame:
        """Rows in word order from an offset; as_hex shows words as their codes."""
        rows = self.rows.orderBy("kmer").offset(offset)
        rows = rows if limit is None else rows.limit(limit)
        return rows.select(hexadecimal(F.col("kmer")).alias("kmer"), "count") if as_hex else rows

    def entry(self, index: int) -> tuple[str, int] | None:
        """The row at a place in word order."""
        row = self.page(1, index).head()
        return (row["kmer"], row["count"]) if row else None

    def mark_unsupported(self, sequences: DataFrame, seq: str = "seq", key: str = "record_id") -> DataFrame:
        return recipes.mark_unsupported(self.rows, sequences, self.k, self.canonical, seq, key)

    # -- reports --------------------------------------------------------------------------------

    def filter(self, least: int | None = None, most: int | None = None) -> KmerTable:
        return replace(self, rows=counting.filter_counts(self.rows, least, most), parts=())

    def filter_report(self, least: int | None = None, most: int | None = None) -> DataFrame:
        return counting.filter_report(self.rows, least, most)

    def stats(self, approximate: bool = False, strict: bool = False) -> DataFrame:
        return stats.summary(self.rows, approximate, strict)

    def histogram(self, fill: bool = True, most_bins: int | None = None) -> DataFrame:
        return stats.histogram(self.rows, fill, most_bins)

    def percentiles(self) -> DataFrame:
        return stats.percentiles(self.rows)

    def report(self) -> DataFrame:
        return counting.counter_report(self.rows, self.k, self.canonical)

    @cached_property
    def size(self) -> int:
        return self.rows.count()

    def info(self) -> dict[str, object]:
        return {"k": self.k, "canonical": self.canonical, "sorted": self.sorted, "distinct_kmers": self.size, "sources": list(self.sources), **self.custom}

    def is_sorted(self) -> bool:
        """Whether the ranges of words of the files do not overlap; one pass, one summary per file (files are few beside rows)."""
        per = self.rows.withColumn("_f", F.input_file_name()).groupBy("_f").agg(F.min("kmer").alias("lo"), F.max("kmer").alias("hi"))
        before = F.max("hi").over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
        return per.withColumn("before", before).where("lo <= before").isEmpty()


def read_metadata(spark: SparkSession, path: str) -> dict:
    try:
        meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/metadata.json").collect()))
    except ValueError as e:
        raise TableError(f"the metadata of {path} cannot be read") from e
    if meta.get("format") != FORMAT:
        raise TableError(f"{path} has format {meta.get('format')!r}, {FORMAT!r} is known")
    for name in ("k", "canonical", "sorted", "distinct_kmers", "total_kmers", "source_files", "custom"):
        if name not in meta:
            raise TableError(f"the metadata of {path} lacks {name!r}")
    check_k(meta["k"])
    return meta


def compatibility(tables: list[KmerTable], mixed: bool = False) -> list[str]:
    """What speaks against a merge, in words; nothing: an empty list. mixed allows canonical with plain tables."""
    if not tables:
        return ["there are no tables"]
    first, found = tables[0], []
    for i, t in enumerate(tables[1:], 2):
        if t.k != first.k:
            found.append(f"table {i} has k={t.k}, the first has k={first.k}")
        if t.canonical != first.canonical and not mixed:
            found.append(f"table {i} is {'canonical' if t.canonical else 'plain'}, the first is not alike")
    return found


def merge(tables: list[KmerTable], policy: str = "exact", mixed: bool = False) -> KmerTable:
    """One table of the sums. With mixed, plain tables are made canonical if any other is."""
    against = compatibility(tables, mixed)
    if against:
        raise TableError("; ".join(against))
    to = any(t.canonical for t in tables)
    rows = [merging.to_canonical(t.rows) if to and not t.canonical else t.rows for t in tables]
    k, named = tables[0].k, tuple(s for t in tables for s in t.sources)
    if k <= packed.SHORT_K or policy != "exact":
        return KmerTable(merging.sum_tables(rows, policy), k, to, False, named)
    # Words made canonical are not like those of their table; then the rows themselves are looked at.
    alike = [t.canonical == to for t in tables]
    parts = [p for t, r, a in zip(tables, rows, alike, strict=True) for p in (t.unsummed() if a else [packed.table_source(r, k)])]
    like = reduce(DataFrame.union, [t._like() if a else packed.rows_like(r, k) for t, r, a in zip(tables, rows, alike, strict=True)])
    return KmerTable(packed.packed_sums(parts, k), k, to, False, named, parts=tuple(parts), like=like)
