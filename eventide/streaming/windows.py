"""Tumbling counts of boundaries and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling_counts(rows: DataFrame, width: str, *by: str, ts: str = "ts", lateness: str | None = None) -> DataFrame:
    """``<by>, start, n``: rows per window of event time, batch or stream.

    Without ``lateness`` a stream counts every row, however late, and keeps one count per window
    and key. With it, a window closes once it is that old, and rows that come later are lost: only for sources that
    are known to keep the bound.
    """
    source = rows.withWatermark(ts, lateness) if lateness else rows
    counts = source.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))
    return counts.select(*by, F.col("window.start").alias("start"), "n")


def append_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's changed counts with the number of the batch.

    A batch that is repeated after a failure replaces its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return stream.foreachBatch(write).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """``<by>, start, n``: the newest count of every window and key."""
    return spark.read.parquet(path).groupBy(*by, "start").agg(F.max_by("n", "batch").alias("n"))
