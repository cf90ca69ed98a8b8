"""Command line: count, query, dump, fuzzy-query, fuzzy-query-batch, merge, stats, prefix-query.

    python -m helixgrid.cli count -k 21 --canonical -o out.table reads.fastq.gz
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sequence import check_k
from .operators import fuzzy
from .operators.counting import check_bounds
from .operators.table import KmerTable, compatibility, merge
from .sources import binary_table, exports
from .sources.sequences import read_sequences


def session() -> SparkSession:
    return SparkSession.builder.appName("helixgrid").getOrCreate()


def open_table(spark: SparkSession, path: str) -> KmerTable:
    """A saved table folder, or a binary table file."""
    import os

    from .sources.sequences import local_path

    return binary_table.read_binary(spark, path) if os.path.isfile(local_path(path)) else KmerTable.load(spark, path)


def put_lines(lines: Iterable[str], path: str | None) -> None:
    """Line by line to a file or the terminal."""
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(line + "\n" for line in lines)
    else:
        sys.stdout.writelines(line + "\n" for line in lines)


def put(df: DataFrame, kind: str, path: str | None) -> None:
    put_lines(exports.rows_as(df, kind), path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixgrid")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=about)

    c = verb("count", "count words of sequence files")
    c.add_argument("inputs", nargs="+")
    c.add_argument("-k", type=int, required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--canonical", action="store_true")
    c.add_argument("--min", type=int)
    c.add_argument("--max", type=int)
    c.add_argument("--format", choices=("table", "binary", "text"), default="table")

    q = verb("query", "look words up")
    q.add_argument("table")
    q.add_argument("words", nargs="*")
    q.add_argument("--file", help="one word per line; # starts a comment")
    q.add_argument("--sequences", help="a sequence file: every window in place")
    q.add_argument("--format", choices=sorted(exports.FORMATS), default="tsv")
    q.add_argument("-o", "--output")

    d = verb("dump", "write a table as text")
    d.add_argument("table")
    d.add_argument("-o", "--output")
    d.add_argument("--limit", type=int)

    for name in ("fuzzy-query", "fuzzy-query-batch"):
        f = verb(name, "approximate lookup")
        f.add_argument("table")
        if name == "fuzzy-query":
            f.add_argument("pattern")
            f.add_argument("--scan", action="store_true", help="answer a query over the limit by a pass over the table")
        else:
            f.add_argument("file", help="one pattern per line; what follows | is ignored")
            f.add_argument("--fail-fast", action="store_true", help="stop at the first query that is malformed or over the limit")
        f.add_argument("--distance", type=int, default=0)
        f.add_argument("--positions", default="")
        f.add_argument("--limit", type=int, default=fuzzy.MAX_VARIANTS)
        f.add_argument("--format", choices=sorted(exports.FORMATS), default="table")
        f.add_argument("-o", "--output")

    m = verb("merge", "sum tables")
    m.add_argument("tables", nargs="+")
    m.add_argument("-o", "--output")
    m.add_argument("--mixed", action="store_true", help="make plain tables canonical if any other is")
    m.add_argument("--policy", choices=("exact", "saturate", "error"), default="exact")
    m.add_argument("--check-compatibility", action="store_true")

    s = verb("stats", "statistics of a table")
    s.add_argument("table")
    s.add_argument("--histogram", action="store_true")
    s.add_argument("--approximate", action="store_true")
    s.add_argument("--max-bins", type=int, help="the last bin holds all larger counts (default: a bin for every count)")
    s.add_argument("--format", choices=sorted(exports.FORMATS), default="table")
    s.add_argument("-o", "--output")

    x = verb("prefix-query", "words of a prefix or gap pattern")
    x.add_argument("table")
    x.add_argument("prefix")
    x.add_argument("--min", type=int)
    x.add_argument("--max", type=int)
    x.add_argument("--format", choices=sorted(exports.FORMATS), default="table")
    x.add_argument("-o", "--output")
    return p


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Upper-case words of a file, one per line; comments, blanks and malformed lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("kmer")).where("kmer <> '' and not startswith(kmer, '#')").where(F.col("kmer").rlike("^[ACGT]+$"))


def patterns_of(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.text(path).select(F.trim(F.split_part("value", F.lit("|"), F.lit(1))).alias("p")).where("p <> '' and not startswith(p, '#')")
    return [r["p"] for r in rows.collect()]


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return run(a)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run(a: argparse.Namespace) -> int:
    if a.verb == "count":
        check_k(a.k)
        check_bounds(a.min, a.max)
        t = KmerTable.count(read_sequences(session(), a.inputs), a.k, a.canonical, least=a.min, most=a.max)
        if a.format == "table":
            t.save(a.output)
        elif a.format == "binary":
            binary_table.write_binary(t, a.output)
        else:
            exports.write_text(t.rows.orderBy("kmer"), a.output)
        return 0
    spark = session()
    if a.verb == "merge":
        tables = [open_table(spark, p) for p in a.tables]
        if a.check_compatibility:
            against = compatibility(tables)
            print("\n".join(against) if against else "compatible")
            return int(bool(against))
        if not a.output:
            raise ValueError("merge needs an output")
        merge(tables, a.policy, a.mixed).save(a.output)
        return 0
    t = open_table(spark, a.table)
    if a.verb == "query":
        if a.sequences:
            put(t.lookup_sequences(read_sequences(spark, [a.sequences])).orderBy("record_id", "pos"), a.format, a.output)
        elif a.file:
            put(t.lookup(listed(spark, a.file)).select("kmer", "count"), a.format, a.output)
        else:
            bad = [w for w in a.words if len(w) != t.k]
            for w in bad:
                print(f"not a word of {t.k} bases: {w}", file=sys.stderr)
            asked = spark.createDataFrame([(w.upper(),) for w in a.words if len(w) == t.k], "kmer string")
            put(t.lookup(asked).where("found").select("kmer", "count"), a.format, a.output)
    elif a.verb == "dump":
        put_lines(exports.lines_dump(t, a.limit), a.output)
    elif a.verb == "fuzzy-query":
        put(t.fuzzy(a.pattern, a.distance, a.positions, a.limit, "scan" if a.scan else "error").select("query", "sequence", "count", "match_type", "distance").orderBy(F.desc("count"), "sequence"), a.format, a.output)
    elif a.verb == "fuzzy-query-batch":
        put(t.fuzzy_batch(patterns_of(spark, a.file), a.distance, a.positions, a.limit, a.fail_fast).orderBy("query_id"), a.format, a.output)
    elif a.verb == "stats":
        put(t.histogram(most_bins=a.max_bins).orderBy("count") if a.histogram else t.stats(a.approximate, strict=True), a.format, a.output)
    elif a.verb == "prefix-query":
        rows = t.gapped(a.prefix) if "{" in a.prefix else t.prefix(a.prefix)
        put(KmerTable(rows, t.k, t.canonical).filter(a.min, a.max).rows.orderBy("kmer"), a.format, a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
