"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of documents.

Defined cases, for every stage: null text counts as empty and fails the quality
rules' base; very long texts are worked on whole; rows that share an id, or have
none, are told apart by their texts, and equal rows count as copies of one
document; null lang, source and n_chars go along as they are (a null source is a
source of its own in the mix); columns beyond those of documents are dropped, so
their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixgrid.llm import mixing, near_dup, packing, rules, substring_dedup
from helixgrid.llm.common import WORD, row_key, staged
from helixgrid.llm.queries import table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose row key is among keys, with their own columns only."""
    return docs.withColumn("row_key", row_key("doc_id")).join(keys.select("row_key"), "row_key", "left_semi").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, which tells rows without an id apart by their text."""
    return docs.select(*COLUMNS, F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")).alias("_key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or that a learned rule rejects go, each by its own verdict, also among rows that share an id or have none."""
    keyed = docs.withColumn("row_key", row_key("doc_id"))
    return _rows(docs, rules.quality_rules(keyed, table(spark, sf_dir, "labels"), carry=("row_key",)).where("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates stays (five-word shingles, 0.8).

    Every row goes by its own verdict, also rows that share an id or have none. One of rows with equal ids and texts stays.
    """
    found = staged(near_dup.near_duplicates(docs, keyed=True).where("kept").select("row_key"), "near-duplicates")
    again = found.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key")
    if again.isEmpty():
        return _rows(docs, found)
    once = found.join(again, "row_key", "left_anti")
    return _rows(docs, once).union(_rows(docs, again).dropDuplicates(["doc_id", "text"]))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of PASSAGE_BYTES or more that occur elsewhere are cut out; documents left without a word go."""
    cut = substring_dedup.substring_dedup(docs, PASSAGE_BYTES, decoded=True, carry=("lang", "source", "n_chars")).withColumnRenamed("kept", "text")
    whole = F.col("n_removed") == 0
    rest = cut.where(whole | F.col("text").rlike(WORD)).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rest.select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole times each, and a seeded choice of one more."""
    keyed = _keyed(docs)
    times = mixing.mix(keyed, key="_key").where("times > 0").select(F.col("_key").alias("_took"), "times").dropDuplicates(["_took"])
    taken = keyed.join(times, F.col("_key") == F.col("_took"))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences; a document taken several times is packed as often."""
    return packing.pack(docs, vocabulary())


#: Passages of over 50 words count; in the shortest words that is about 200 bytes.
PASSAGE_BYTES = 200

STAGES = [("quality rules", quality), ("near-duplicates", one_of_each), ("repeated passages", passages), ("source mix", mixed), ("packing", packed)]

#: Learned rules, signatures and the knapsack are not expressible in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
