"""Tables and results as text, JSON, CSV and TSV.

`write_*` go through Spark's writers and scale. `lines_*` and `rows_as` give
lines one by one, a partition at a time on the driver, for files and terminals;
`as_*` join those lines for small results.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.table import KmerTable, checksum  # noqa: F401


def _line() -> F.Column:
    return F.concat_ws("\t", "kmer", F.col("count").cast("string"))


def write_text(rows: DataFrame, path: str) -> None:
    """word, tab, count; no header."""
    rows.select(_line().alias("value")).write.text(path)


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.option("header", True).option("sep", sep).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One object per line."""
    rows.write.json(path)


def write_fasta(records: DataFrame, path: str, width: int = 60) -> None:
    """record_id, description, seq as FASTA files of wrapped lines."""
    head = F.concat(F.lit(">"), F.concat_ws(" ", "record_id", F.nullif("description", F.lit(""))))
    body = F.regexp_replace(F.coalesce("seq", F.lit("")), f"(.{{{width}}})(?=.)", "$1\n")
    records.select(F.concat(head, F.lit("\n"), body).alias("value")).write.text(path)


def write_fastq(records: DataFrame, path: str) -> None:
    """record_id, description, seq, qual as FASTQ files."""
    head = F.concat(F.lit("@"), F.concat_ws(" ", "record_id", F.nullif("description", F.lit(""))))
    records.select(F.concat_ws("\n", head, F.coalesce("seq", F.lit("")), F.lit("+"), F.coalesce("qual", F.lit(""))).alias("value")).write.text(path)


def _v1_head(table: KmerTable) -> list[str]:
    return ["# kmer text format v1", f"# kmer_length: {table.k}", f"# total_kmers: {table.size}", "# format: kmer_sequence<TAB>count"]


def write_text_v1(table: KmerTable, path: str) -> None:
    """The table in word order behind four comment lines: the comments are the first file, the words follow in range order."""
    spark = table.spark
    head = spark.createDataFrame([(line,) for line in _v1_head(table)], "value string").coalesce(1)
    head.union(table.rows.orderBy("kmer").select(_line().alias("value"))).write.text(path)


def _values(rows: DataFrame) -> Iterator[str]:
    return (r["value"] for r in rows.select(_line().alias("value")).toLocalIterator(prefetchPartitions=True))


def lines_text(table: KmerTable, limit: int | None = None, offset: int = 0, header: bool = True) -> Iterator[str]:
    """A page of the table in word order, with four comment lines before it."""
    if header:
        yield from _v1_head(table)
    yield from _values(table.page(limit, offset))


def lines_dump(table: KmerTable, limit: int | None = None) -> Iterator[str]:
    """Seven comment lines, then rows in stored order."""
    yield from ["# k-mer table dump", f"# k-mer size: {table.k}", f"# distinct k-mers: {table.size}", f"# sorted: {str(table.sorted).lower()}", f"# canonical: {str(table.canonical).lower()}", "# format: kmer<TAB>count", "#"]
    yield from _values(table.rows if limit is None else table.rows.limit(limit))


def text_lines(table: KmerTable, limit: int | None = None, offset: int = 0, header: bool = True) -> list[str]:
    return list(lines_text(table, limit, offset, header))


def dump_lines(table: KmerTable, limit: int | None = None) -> list[str]:
    return list(lines_dump(table, limit))


def table_json(table: KmerTable, limit: int | None = None, offset: int = 0) -> str:
    """kmer_length, canonical_mode, totals and the words of a page."""
    total = table.stats().first()
    rows = [{"kmer": r["kmer"], "count": r["count"]} for r in table.page(limit, offset).toLocalIterator()]
    return json.dumps({"kmer_length": table.k, "canonical_mode": table.canonical, "total_kmers": total["total_kmers"] or 0, "unique_kmers": total["unique_kmers"], "kmers": rows})


def summary_text(table: KmerTable) -> str:
    r = table.stats().first()
    mean = f"{r['mean_count']:.2f}" if r["unique_kmers"] else "0.00"
    return f"Total k-mers: {r['total_kmers'] or 0}\nUnique k-mers: {r['unique_kmers']}\nAverage count: {mean}\n"


def _json_lines(df: DataFrame) -> Iterator[str]:
    """One array, an object on each line."""
    held = None
    yield "["
    for r in df.toLocalIterator(prefetchPartitions=True):
        if held is not None:
            yield held + ","
        held = json.dumps(dict(zip(df.columns, r, strict=True)))
    if held is not None:
        yield held
    yield "]"


def _separated(df: DataFrame, sep: str) -> Iterator[str]:
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator="")
    for row in chain([df.columns], df.toLocalIterator(prefetchPartitions=True)):
        writer.writerow(list(row))
        yield out.getvalue()
        out.seek(0)
        out.truncate()


def _table_lines(df: DataFrame) -> Iterator[str]:
    """Columns padded to their widest value, which a pass finds first."""
    shown = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in df.columns])
    widest = shown.agg(*[F.max(F.length(c)).alias(c) for c in df.columns]).first()
    widths = [max(len(c), widest[c] or 0) for c in df.columns]
    for row in chain([df.columns], shown.toLocalIterator(prefetchPartitions=True)):
        yield "  ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)).rstrip()


FORMATS = {"table": _table_lines, "json": _json_lines, "csv": lambda df: _separated(df, ","), "tsv": lambda df: _separated(df, "\t")}


def rows_as(df: DataFrame, kind: str = "table") -> Iterator[str]:
    """The rows of df as lines of a format; the driver holds a partition at a time."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    return FORMATS[kind](df)


def formatted(df: DataFrame, kind: str = "table") -> str:
    """All lines of a small result as one text."""
    return "\n".join(rows_as(df, kind)) + "\n"


def as_rows(df: DataFrame) -> tuple[list[str], list[list]]:
    return df.columns, [list(r) for r in df.toLocalIterator()]


def as_dicts(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.toLocalIterator()]


def format_kmer(word: str, canonical: bool) -> str:
    return word.upper() if canonical else word


def format_count(word: str, count: int, kind: str = "compact") -> str:
    """json, verbose or compact."""
    return json.dumps({"kmer": word, "count": count}) if kind == "json" else f"k-mer: {word}, count: {count}" if kind == "verbose" else f"{word}\t{count}"
