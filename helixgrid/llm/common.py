"""Shared pieces of the corpus operators: words, staged tables, batching."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, shared_dir  # noqa: F401

#: What separates words everywhere in this subpackage: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8 bytes; bytes.split() cuts at exactly the separators of WORD.

    Lower-casing touches A-Z only, as bytes.lower() does. Null text: no words.
    """
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser) over an array."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _MIX1
    x ^= x >> U64(27)
    x *= _MIX2
    x ^= x >> U64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words seen; emptied when it holds `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, batch: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """df through a function of one Arrow batch at a time."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield batch(pdf)

    return df.mapInPandas(run, schema)


def mapped_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 250) -> DataFrame:
    """df.mapInPandas(run, schema) by a few rows at a time: of a batch of long texts only these become Python objects."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def parts(batches) -> Iterator:
        import pyarrow as pa

        cut = (b.slice(at, rows).to_pandas() for b in batches for at in range(0, b.num_rows, rows))
        for out in run(cut):
            yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    return df.mapInArrow(parts, schema)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def row_key(key: str, text: str = "text") -> Column:
    """A 64-bit hash of a row's key and text, never null: tells rows of one id, or of none, apart; equal rows share it."""
    return F.xxhash64(F.col(key), F.col(text))


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, by a hash of the key: a bounded sample that does not depend on partitioning."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of about `most` bytes each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def sent(spark: SparkSession, value) -> Callable:
    """Broadcasts a value of bounded size; the result gives it on executors, with the classes of this package it uses."""
    from pyspark import cloudpickle

    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)
