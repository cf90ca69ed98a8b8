"""Incremental counting with Structured Streaming.

Sequences that arrive as a stream are counted by the same window extraction;
state is the running count of each word, kept and recovered by the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import explode_windows


def counted_stream(sequences: DataFrame, k: int, canonical: bool = False, seq: str = "seq") -> DataFrame:
    """kmer, count of everything that has arrived (update or complete mode)."""
    return explode_windows(sequences, k, canonical, seq).groupBy("kmer").agg(F.count("*").alias("count"))


def windowed_stream(sequences: DataFrame, k: int, time: str, width: str, late: str, canonical: bool = False, seq: str = "seq") -> DataFrame:
    """Counts per time window; rows later than the watermark are dropped and old windows are closed."""
    words = explode_windows(sequences.withWatermark(time, late), k, canonical, seq, (time,))
    return words.groupBy(F.window(time, width), "kmer").agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "kmer", "count")


def run_to_path(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs over what is there now and keeps the result as Parquet: the last whole result (complete), or every row that is final (append).

    Rows go from the tasks to the files. A batch that is run again writes the same folder again.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={batch}")

    return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
