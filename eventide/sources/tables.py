"""The supplied tables as sequences (see FIXTURES.md part 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventide.operators.positions import dense_positions

#: Start of the recording in ``events``; presses are counted in milliseconds from it.
RECORDING_START = "2024-01-01 00:00:00"


def _start():
    return F.lit(RECORDING_START).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_scenes(spark: SparkSession, sf_dir: str, length: int = 10) -> DataFrame:
    """Sequences of ``length`` consecutive vectors; labels change at most positions."""
    return table(spark, sf_dir, "embeddings").select(
        F.call_function("div", F.col("vec_id"), F.lit(length)).alias("seq_id"),
        (F.col("vec_id") % length).cast("bigint").alias("pos"),
        F.col("label"),
        F.col("embedding").alias("scene"),
        F.col("vec_id"),
    )


def long_scenes(spark: SparkSession, sf_dir: str, length: int = 100) -> DataFrame:
    """Sequences ordered by label, so that labels persist."""
    raw = table(spark, sf_dir, "embeddings").select(
        F.call_function("div", F.col("vec_id"), F.lit(length)).alias("seq_id"),
        F.col("label"),
        F.col("embedding").alias("scene"),
        F.col("vec_id"),
    )
    return dense_positions(raw, ["label", "vec_id"], bucket=F.col("label"))


def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("seq_id"),
        F.col("turn").cast("bigint").alias("pos"),
        F.col("role").alias("label"),
        F.col("text"),
    )


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sequence per user, ordered by time."""
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seq_id"),
        F.col("event_type").alias("label"),
        F.col("ts"),
        F.col("event_id"),
    )
    return dense_positions(raw, ["ts", "event_id"], bucket=F.timestamp_diff("HOUR", _start(), F.col("ts")))


def presses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Button presses: subject = user, movie = event type, milliseconds from the start."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subj"),
        F.col("event_type").alias("movie"),
        (F.timestamp_diff("MICROSECOND", _start(), F.col("ts")) / 1000.0).alias("ms"),
    )
