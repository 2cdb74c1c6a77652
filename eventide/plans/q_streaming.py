"""Streams run to completion over the supplied tables."""

from __future__ import annotations

import os
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventide.functions import text as X
from eventide.operators import segment as G
from eventide.operators.encode import encode
from eventide.operators.positions import with_lag
from eventide.operators.resume import handed_over, resume
from eventide.plans.q_segment import ASSIGNED, LONG_SRC, MIXED, SHORT_SRC, SIGNAL_CASES, TEXT_SRC, _walk
from eventide.plans.registry import query
from eventide.session import ensure_checkpoint_dir
from eventide.sources import tables
from eventide.streaming.segment import append_turns, passed_rows, segment_stream, unfinished
from eventide.streaming.windows import append_counts, latest_counts, tumbling_counts


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the session's checkpoints."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files (hence the pattern)."""
    schema = tables.table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 8)
        .parquet(f"{sf_dir}/{name}[.]parquet")
    )


def _scene_stream(spark, sf_dir):
    return _stream(spark, sf_dir, "embeddings").select(
        F.call_function("div", F.col("vec_id"), F.lit(10)).alias("seq_id"),
        (F.col("vec_id") % 10).cast("bigint").alias("pos"),
        F.col("embedding").alias("scene"),
    )


def _run(spark, assigned, config, buckets=4):
    """All assigned rows. Late, repeated and unplaced rows go to the table ``passed`` beside them, and a warning names it."""
    folder = _folder(spark, "turns")
    checkpoint = f"{folder}/checkpoint"
    append_turns(assigned, f"{folder}/table", checkpoint, buckets).awaitTermination()
    columns = ["seq_id", "pos", "topic", "is_boundary"]
    schema = assigned.select(*columns, "late").schema
    turns = spark.read.schema(schema).parquet(f"{folder}/table").select(columns)
    passed_rows(spark, checkpoint).write.parquet(f"{folder}/passed")
    n = spark.read.parquet(f"{folder}/passed").count()
    if n:
        warnings.warn(f"{n} late, repeated or unplaced rows are in {folder}/passed", stacklevel=2)
    unfinished(spark, checkpoint, config).write.parquet(f"{folder}/unfinished")
    return turns.union(spark.read.schema(turns.schema).parquet(f"{folder}/unfinished"))


@query("stream_segment", _walk(SHORT_SRC, [MIXED], ASSIGNED + " "))
def stream_segment(spark, sf_dir):
    return _run(spark, segment_stream(_scene_stream(spark, sf_dir), MIXED), MIXED)


MOVED = G.Config(alpha=1.0, lmda=3.0, sigma0_sq=0.1, scorer="max_c_l", new_score=0.1, k_max=64)


@query("stream_anchors", _walk(SHORT_SRC, [MOVED], ASSIGNED + " "))
def stream_anchors(spark, sf_dir):
    """Topic means and last scenes as anchors, both kept in the stream's state."""
    return _run(spark, segment_stream(_scene_stream(spark, sf_dir), MOVED), MOVED)


@query("stream_signals", _walk(TEXT_SRC, [SIGNAL_CASES[2]], ASSIGNED + " "))
def stream_signals(spark, sf_dir):
    """Dialogue turns by meaning, tokens and entities; the state keeps which topics hold a token."""
    turns = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq_id"), F.col("turn").cast("bigint").alias("pos"), "text")
    scenes = encode(turns.withColumns({"tokens": X.tokens("text"), "entities": X.entities("text")}))
    return _run(spark, segment_stream(scenes, SIGNAL_CASES[2]), SIGNAL_CASES[2])


@query("segment_resumed", _walk(LONG_SRC, [MIXED], ASSIGNED + " "))
def segment_resumed(spark, sf_dir):
    """Two batch runs, the second one from the state table of the first."""
    scenes, early = tables.long_scenes(spark, sf_dir), F.col("pos") % 100 < 29 + F.col("seq_id") % 30
    first = scenes.where(early)
    return resume(first, None, MIXED).union(resume(scenes.where(~early), handed_over(first, MIXED), MIXED))


@query("stream_counts", """select event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n from events group by 1, 2""")
def stream_counts(spark, sf_dir):
    """Counts of all rows, in whatever order and number of files they come."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = _folder(spark, "counts")
    append_counts(tumbling_counts(events, "1 day", "event_type"), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    latest = latest_counts(spark, f"{folder}/table", "event_type")
    return latest.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@query("boundary_counts", """with s as (select ts, event_type <> lag(event_type) over (partition by user_id order by ts, event_id) as b from events)
select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) as n from s where b group by 1""")
def boundary_counts(spark, sf_dir):
    lagged = with_lag(tables.event_turns(spark, sf_dir), {"_prev": "label"})
    shifts = lagged.where((F.col("pos") > 0) & (F.col("label") != F.col("_prev")))
    counts = tumbling_counts(shifts, "1 hour")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n")
