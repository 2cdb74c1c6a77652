"""Sinks for metrics, reports and the long-term table of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_metrics(metrics: DataFrame, path: str, experiment: str, fmt: str = "parquet") -> None:
    """Append the metric rows of one experiment, one folder per experiment."""
    tagged = metrics.withColumn("experiment", F.lit(experiment))
    tagged.write.mode("append").partitionBy("experiment").format(fmt).save(path)


def write_turns(assigned: DataFrame, path: str, buckets: int = 256) -> None:
    """Turns with their topic, in folders by sequence bucket.

    ``pos`` enters the shuffle key, so one long sequence is written by many tasks.
    """
    spread = assigned.withColumn("bucket", F.pmod(F.xxhash64("seq_id"), F.lit(buckets)))
    block = F.floor(F.col("pos") / 1_000_000)
    (
        spread.repartition("bucket", block)
        .sortWithinPartitions("bucket", "seq_id", "pos")
        .write.mode("append")
        .partitionBy("bucket")
        .parquet(path)
    )
