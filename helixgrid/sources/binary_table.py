"""The fixed-width binary table format: a 42-byte header and 20-byte rows.

Rows have one size, so `spark.read.format("kmerdb")` cuts a file into ranges
of rows and reads them in parallel. Writing makes one file, so it streams the
sorted rows through one writer; Parquet is the format for large tables.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.sequence import check_k
from ..operators.counting import CEILING
from ..operators.table import KmerTable, TableError
from .sequences import discover, local_path

# Fixed values of the format: magic, version, header and row layouts (little-endian).
MAGIC, VERSION = b"RKDB", 2
HEADER = "<4sHBxxxQB7xQQ"
HEADER_BYTES = struct.calcsize(HEADER)
SORTED, CANONICAL = 1, 2
ROW = np.dtype([("lo", "<u8"), ("hi", "<u8"), ("count", "<u4")])
ROWS_PER_PARTITION = 2_000_000


@dataclass(frozen=True)
class Header:
    k: int
    rows: int
    sorted: bool
    canonical: bool
    offset: int = HEADER_BYTES

    def pack(self) -> bytes:
        return struct.pack(HEADER, MAGIC, VERSION, self.k, self.rows, SORTED * self.sorted | CANONICAL * self.canonical, self.offset, 0)


def read_header(path: str) -> Header:
    """The header of a file, from its first bytes alone."""
    with open(local_path(path), "rb") as f:
        data = f.read(HEADER_BYTES)
    if len(data) < HEADER_BYTES:
        raise TableError(f"{path} is too short for a header")
    magic, version, k, rows, flags, offset, _ = struct.unpack(HEADER, data)
    if magic != MAGIC:
        raise TableError(f"{path} is not a binary table")
    if version != VERSION:
        raise TableError(f"{path} has version {version}, {VERSION} is known")
    check_k(k)
    size = os.path.getsize(local_path(path))
    if size < offset + rows * ROW.itemsize:
        raise TableError(f"{path} declares {rows} rows, {(size - offset) // ROW.itemsize} are there")
    return Header(k, rows, bool(flags & SORTED), bool(flags & CANONICAL), offset)


def words_of(lo: np.ndarray, hi: np.ndarray, k: int) -> list[str]:
    """Codes of 128 bits -> words."""
    letters = np.frombuffer(b"ACGT", np.uint8)
    out = np.empty((len(lo), k), np.uint8)
    for i in range(k):
        shift = 2 * (k - 1 - i)
        code = (lo >> np.uint64(shift)) if shift < 64 else (hi >> np.uint64(shift - 64))
        out[:, i] = letters[(code & np.uint64(3)).astype(np.int64)]
    return [w.decode() for w in out.view(f"S{k}").ravel().tolist()]


def codes_of(words: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words -> (lo, hi) of their codes."""
    place = np.zeros(256, np.uint64)
    for i, b in enumerate(b"ACGT"):
        place[b] = i
    table = place[np.frombuffer("".join(words).encode(), np.uint8)].reshape(len(words), k)
    lo, hi = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for i in range(k):
        shift = 2 * (k - 1 - i)
        if shift < 64:
            lo |= table[:, i] << np.uint64(shift)
        else:
            hi |= table[:, i] << np.uint64(shift - 64)
    return lo, hi


class _Range(InputPartition):
    def __init__(self, path: str, k: int, at: int, rows: int):
        super().__init__((path, at))
        self.path, self.k, self.at, self.rows = path, k, at, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.parts = []
        for path in filter(None, options.get("path", "").split(",")):
            files = [path] if os.path.isfile(local_path(path)) else [os.path.join(local_path(path), n) for n in sorted(os.listdir(local_path(path))) if not n.startswith(".")]
            for f in files:
                h = read_header(f)
                self.parts += [_Range(f, h.k, h.offset + i * ROW.itemsize, min(ROWS_PER_PARTITION, h.rows - i)) for i in range(0, h.rows, ROWS_PER_PARTITION)]

    def partitions(self):
        return self.parts

    def read(self, partition):
        import pyarrow as pa

        with open(local_path(partition.path), "rb") as f:
            f.seek(partition.at)
            left = partition.rows
            while left:
                rows = np.frombuffer(f.read(min(left, 50_000) * ROW.itemsize), ROW)
                left -= len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(words_of(rows["lo"], rows["hi"], partition.k)), pa.array(rows["count"].astype(np.int64))], names=["kmer", "count"])


class BinaryTableSource(DataSource):
    """format("kmerdb")"""

    @classmethod
    def name(cls):
        return "kmerdb"

    def schema(self):
        return "kmer string, count long"

    def reader(self, schema):
        return _Reader(dict(self.options))


def read_binary(spark: SparkSession, path: str) -> KmerTable:
    h = read_header(path)
    if not h.rows:
        return KmerTable.empty(spark, h.k, h.canonical)
    spark.dataSource.register(BinaryTableSource)
    return KmerTable(spark.read.format("kmerdb").load(path), h.k, h.canonical, h.sorted, (path,))


def write_binary(table: KmerTable, path: str, in_order: bool = True) -> Header:
    """Writes one file; counts stop at the format's ceiling. Rows stream through the driver a partition at a time."""
    rows: DataFrame = table.rows.select("kmer", F.least("count", F.lit(CEILING)).alias("count"))
    rows = rows.orderBy("kmer") if in_order else rows
    n = 0
    with open(local_path(path), "wb") as f:
        f.write(Header(table.k, 0, in_order, table.canonical).pack())
        held: list = []

        def flush() -> None:
            lo, hi = codes_of([r["kmer"] for r in held], table.k)
            out = np.empty(len(held), ROW)
            out["lo"], out["hi"], out["count"] = lo, hi, [r["count"] for r in held]
            f.write(out.tobytes())
            held.clear()

        for r in rows.toLocalIterator(prefetchPartitions=True):
            held.append(r)
            n += 1
            if len(held) == 100_000:
                flush()
        if held:
            flush()
        header = Header(table.k, n, in_order, table.canonical)
        f.seek(0)
        f.write(header.pack())
    return header
