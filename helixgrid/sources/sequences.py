"""FASTA and FASTQ, plain or compressed, from any file system that Spark reads.

`read_fasta` and `read_fastq` cut records with Spark's text reader and a line
separator of newline and marker, so a plain file is split over tasks and a gzip
or bzip2 file is one stream through its codec; Python sees no record. Files
compressed with xz, which Hadoop has no codec for, go through the data sources
`spark.read.format("fasta")` and `format("fastq")`, which open local paths.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# File extensions by kind, with or without a compression's.
EXTENSIONS = {"fasta": ("fa", "fasta", "fna", "ffn"), "fastq": ("fq", "fastq")}
COMPRESSED = ("gz", "bz2", "xz")
BATCH = 1000


class SequenceError(ValueError):
    """A file that does not follow its format."""


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:") else path


def open_text(path: str):
    """A file as text lines, by its compression's extension; gzip files of many members are read through."""
    path = local_path(path)
    opener = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}.get(path.rsplit(".", 1)[-1], open)
    return opener(path, "rt", encoding="utf-8", errors="replace", newline=None)


def kind_of(name: str) -> str | None:
    """fasta, fastq or None by extension."""
    parts = os.path.basename(name).lower().split(".")
    if parts[-1] in COMPRESSED:
        parts.pop()
    return next((kind for kind, own in EXTENSIONS.items() if len(parts) > 1 and parts[-1] in own), None)


def guessed_kind(name: str) -> str:
    """As kind_of; for other names FASTQ if the name says so, else FASTA."""
    base = os.path.basename(name).lower()
    return kind_of(name) or ("fastq" if "fastq" in base or "fq" in base else "fasta")


@dataclass(frozen=True)
class Found:
    path: str
    kind: str
    bytes: int
    compressed: bool


def discover(root: str, kind: str | None = None, least: int = 0, most: int | None = None, depth: int | None = None, links: bool = False) -> list[Found]:
    """Sequence files under a folder (or the one file), sorted by path; names that start with a dot are skipped."""
    root = local_path(root)
    if os.path.isfile(root):
        return [Found(root, kind or guessed_kind(root), os.path.getsize(root), root.endswith(COMPRESSED))]
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    found = []
    for folder, inner, names in os.walk(root, followlinks=links):
        level = 0 if folder == root else os.path.relpath(folder, root).count(os.sep) + 1
        inner[:] = [] if depth is not None and level >= depth else [d for d in inner if not d.startswith(".")]
        for name in names:
            path = os.path.join(folder, name)
            own = kind_of(name)
            if name.startswith(".") or not own or (kind and own != kind) or (os.path.islink(path) and not links):
                continue
            size = os.path.getsize(path)
            if size >= least and (most is None or size <= most):
                found.append(Found(path, own, size, name.lower().endswith(COMPRESSED)))
    return sorted(found, key=lambda f: f.path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path in any of Hadoop's file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return fs.getFileStatus(p).isDirectory()


def _any_case(text: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in text)


def file_pattern(kind: str, compressed: tuple[str, ...] = ("gz", "bz2")) -> str:
    """A glob for the names of one kind, in either case."""
    return "*.{" + ",".join(_any_case(e + c) for e in EXTENSIONS[kind] for c in ("", *("." + x for x in compressed))) + "}"


def discovered(spark: SparkSession, root: str, kind: str | None = None, least: int = 0, most: int | None = None, depth: int | None = None) -> DataFrame:
    """path, kind, bytes, compressed of the sequence files under a folder of any file system, listed by Spark without reading them.

    Names that start with a dot or an underscore and files without a byte are skipped, as everywhere in Spark.
    """
    fs, p = hadoop_path(spark, root)
    base = fs.makeQualified(p).toString().rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    own = F.regexp_replace(name, rf"\.({'|'.join(COMPRESSED)})$", "")
    found = F.lit(None).cast("string")
    for each, endings in EXTENSIONS.items():
        found = F.when(own.rlike(rf".*\.({'|'.join(endings)})$"), each).otherwise(found)
    out = rows.select("path", found.alias("kind"), "bytes", name.rlike(rf"\.({'|'.join(COMPRESSED)})$").alias("compressed")).where(F.col("kind").isNotNull() & (F.col("bytes") >= least))
    if kind:
        out = out.where(F.col("kind") == kind)
    if most is not None:
        out = out.where(F.col("bytes") <= most)
    if depth is not None:
        below = F.expr(f"substring(replace(path, 'file:///', 'file:/'), {len(base.replace('file:///', 'file:/')) + 1})")
        out = out.where(F.size(F.split(below, "/")) <= depth + 1)
    return out


def summary_of(found: DataFrame) -> DataFrame:
    """kind, files, bytes, compressed of discovered files."""
    return found.groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if("compressed").alias("compressed"))


def discovery_summary(spark: SparkSession, found: list[Found]) -> DataFrame:
    """kind, files, bytes, compressed."""
    return summary_of(spark.createDataFrame([(f.kind, f.bytes, f.compressed) for f in found], "kind string, bytes long, compressed boolean"))


def _marked(spark: SparkSession, path: str, kind: str, marker: str, names: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", "\n" + marker).option("recursiveFileLookup", True)
    if is_folder(spark, path):
        reader = reader.option("pathGlobFilter", names or file_pattern(kind))
    return reader.text(path)


def _named(head: Column) -> tuple[Column, Column]:
    """(record id, description) of a header without its marker."""
    head = F.trim(F.translate(head, "\r\t", "  "))
    first = F.substring_index(head, " ", 1)
    return first, F.trim(F.substring(head, F.length(first) + 1, F.length(head)))


def read_fasta(spark: SparkSession, path: str, strict: bool = False, names: str | None = None) -> DataFrame:
    """file, record_id, description, seq of a file or of all FASTA files under a folder (names: a glob instead of the known endings).

    Lines of a sequence are joined and white space inside is dropped; markers repeated at the start of a
    header count once; a record without name and sequence is dropped. strict: a pass first makes sure that
    every file begins with a header.
    """
    rows = _marked(spark, path, "fasta", ">", names).select(F.col("_metadata.file_path").alias("file"), "value")
    if strict:
        bad = rows.where(F.col("value").rlike(r"\S")).groupBy("file").agg(F.count_if(F.ltrim("value").startswith(">")).alias("n")).where("n = 0").head()
        if bad:
            raise SequenceError(f"{bad['file']} has a sequence before the first header")
    line = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(line) + 1, F.length("value"))
    for blank in ("\n", "\r", " ", "\t"):
        body = F.replace(body, F.lit(blank), F.lit(""))
    name, about = _named(F.ltrim(F.ltrim(line), F.lit(">")))
    return rows.select("file", name.alias("record_id"), about.alias("description"), body.alias("seq")).where("record_id <> '' or seq <> ''")


def read_fastq(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """file, record_id, description, seq, qual of a file or of all FASTQ files under a folder (names: as read_fasta); records of four lines.

    A quality may begin with the marker, and is then cut from its record. Such halves are known by their number
    of lines and are joined again by their places: next to each other in a task, or at the seam of two pieces of
    a file. Halves that find no partner, and qualities of another length than their sequence, are errors.
    """
    meta = F.col("_metadata")
    raw = _marked(spark, path, "fastq", "@", names).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("_start"), (meta["file_block_start"] + meta["file_block_length"]).alias("_end"), F.monotonically_increasing_id().alias("_n"), F.rtrim("value", F.lit("\r\n")).alias("_v"))
    rows = raw.withColumn("_l", F.split("_v", "\r?\n"))
    lines = F.size("_l")
    at = lambda i: F.get("_l", F.lit(i))
    whole = (lines == 4) | ((lines == 3) & (at(1) == ""))
    record = lambda qual: (at(0).alias("_h"), at(1).alias("seq"), at(2).alias("_plus"), qual.alias("qual"))
    complete = rows.where(whole).select("file", *record(F.coalesce(at(3), F.lit(""))))
    heads = rows.where((lines == 3) & ~whole).select("file", "_end", (F.col("_n") + 1).alias("_n"), *record(F.lit("@")))
    # What is left of a quality is one line, also an empty one; the blank lines of an empty file are no record.
    tails = rows.where((lines < 3) | (lines > 4)).select("file", "_start", "_n", F.col("_v").alias("_rest"), lines.alias("_lines"))
    near = heads.join(tails, ["file", "_n"], "full_outer")
    joined = near.where("_h is not null and _rest is not null")
    lone_heads, lone_tails = near.where("_rest is null").select("file", "_end", "_h", "seq", "_plus", "qual"), near.where("_h is null").select("file", "_start", "_rest", "_lines")
    seam = lone_heads.withColumnRenamed("_end", "_at").join(lone_tails.withColumnRenamed("_start", "_at"), ["file", "_at"], "full_outer")
    seam = seam.where("_h is not null or _rest <> ''")
    halves = joined.select("file", "_h", "seq", "_plus", "qual", "_rest").union(seam.select("file", "_h", "seq", "_plus", "qual", "_rest"))
    every = complete.union(halves.select("file", F.coalesce("_h", "_rest"), "seq", F.coalesce("_plus", F.lit("")), F.concat("qual", "_rest")))
    fits = F.col("_plus").startswith("+") & (F.length("seq") == F.length("qual"))
    seq = F.when(F.coalesce(fits, F.lit(False)), F.trim("seq")).otherwise(F.raise_error(F.concat(F.lit("no record of four lines with a quality for each base: "), F.substring("_h", 1, 60))).cast("string"))
    name, about = _named(F.ltrim("_h", F.lit("@")))
    return every.select("file", name.alias("record_id"), about.alias("description"), seq.alias("seq"), "qual")


def fasta_records(lines) -> Iterator[tuple[str, str, str]]:
    """(id, description, sequence); sequences may span lines, blank lines are skipped."""
    name, parts = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if name is not None:
                yield (*name, "".join(parts))
            head, _, about = line[1:].strip().partition(" ")
            name, parts = (head, about.strip()), []
        elif line:
            if name is None:
                raise SequenceError("a sequence before the first header")
            parts.append(line)
    if name is not None:
        yield (*name, "".join(parts))


def fastq_records(lines) -> Iterator[tuple[str, str, str, str]]:
    """(id, description, sequence, quality) of records of four lines."""
    rows = iter(lines)
    for head in rows:
        head = head.rstrip("\r\n")
        if not head.strip():
            continue
        seq, plus, qual = (next(rows, None) for _ in range(3))
        if not head.startswith("@") or qual is None or not plus.startswith("+"):
            raise SequenceError(f"no record of four lines at {head[:60]!r}")
        seq, qual = seq.strip(), qual.rstrip("\r\n")
        if len(seq) != len(qual):
            raise SequenceError(f"{head[:60]!r}: {len(seq)} bases, {len(qual)} qualities")
        name, _, about = head[1:].strip().partition(" ")
        yield name, about.strip(), seq, qual


def validate(path: str, kind: str | None = None, records: int = 10) -> list[str]:
    """Parses the first records; an error for none, warnings for empty names or sequences."""
    kind = kind or guessed_kind(path)
    seen, warnings = 0, []
    with open_text(path) as lines:
        for r in fasta_records(lines) if kind == "fasta" else fastq_records(lines):
            seen += 1
            if not r[0]:
                warnings.append(f"record {seen} has no name")
            if not r[2]:
                warnings.append(f"record {seen} has no sequence")
            if seen == records:
                break
    if not seen:
        raise SequenceError(f"{path} has no record")
    return warnings


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict, columns: list[str]):
        self.kind, self.columns = kind, columns
        paths = [p for p in options.get("path", "").split(",") if p]
        self.files = [f for p in paths for f in discover(p, kind, depth=int(options["depth"]) if "depth" in options else None) if f.path.lower().endswith(options.get("only", ""))]

    def partitions(self):
        return [_File(f.path) for f in self.files]

    def read(self, partition):
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], names=self.columns)

        rows = []
        with open_text(partition.path) as lines:
            for r in fasta_records(lines) if self.kind == "fasta" else fastq_records(lines):
                rows.append((partition.path, *r))
                if len(rows) >= BATCH or len(r[2]) > 1 << 22:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class FastaSource(DataSource):
    """format("fasta")"""

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return "file string, record_id string, description string, seq string"

    def reader(self, schema):
        return _Reader("fasta", dict(self.options), ["file", "record_id", "description", "seq"])


class FastqSource(DataSource):
    """format("fastq")"""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return "file string, record_id string, description string, seq string, qual string"

    def reader(self, schema):
        return _Reader("fastq", dict(self.options), ["file", "record_id", "description", "seq", "qual"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)
    spark.dataSource.register(FastqSource)


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, record_id, seq of FASTA and FASTQ files and folders alike, in any file system that Spark reads."""
    parts = []
    readers = {"fasta": read_fasta, "fastq": read_fastq}
    for path in paths:
        if not is_folder(spark, path):
            found = {(guessed_kind(path), path.lower().endswith(".xz"))}
        else:
            kinds = discovered(spark, path).select("kind", F.lower("path").endswith(".xz").alias("xz")).distinct()
            found = {(r["kind"], r["xz"]) for r in kinds.collect()}  # four at most
        for kind, packed in sorted(found):
            if packed:
                register(spark)
                parts.append(spark.read.format(kind).option("only", "xz").load(path).select("file", "record_id", "seq"))
            else:
                parts.append(readers[kind](spark, path).select("file", "record_id", "seq"))
    if not parts:
        raise FileNotFoundError(f"no sequence files in {paths}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def watched(sequences: DataFrame, name: str = "scan", seq: str = "seq") -> tuple[DataFrame, Observation]:
    """The rows, and what the action that reads them has seen of them: records and bases, in its `get` when it is done.

    The numbers come along with the scan, without a pass of their own; while it runs, Spark's own progress reports hold them by name.
    """
    seen = Observation(name)
    return sequences.observe(seen, F.count("*").alias("records"), F.coalesce(F.sum(F.length(seq)), F.lit(0)).alias("bases")), seen


def totals(sequences: DataFrame) -> DataFrame:
    """records and total_length."""
    return sequences.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("total_length"))


def average_quality(reads: DataFrame, qual: str = "qual") -> Column:
    """An aggregate: the mean raw ASCII quality over all places of all reads; null where there is none."""
    from ..functions.sequence import mean_quality

    total, n = mean_quality(F.col(qual))
    return F.sum(total) / F.nullif(F.sum(n), F.lit(0))


def filter_quality(reads: DataFrame, least: int, qual: str = "qual") -> DataFrame:
    """Reads of which every quality byte (raw ASCII) reaches the least."""
    from ..functions.sequence import quality_at_least

    return reads.where(quality_at_least(F.col(qual), least))
