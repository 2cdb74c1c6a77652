"""Sources. Every reader returns ``seq_id, pos, ...`` so order is explicit in the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventide import schema as S
from eventide.operators.positions import dense_positions


def read_factoid_turns(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON array of turns (or JSON lines, which Spark can split) keyed by (seq_id, pos).

    ``turn_no`` keeps the delivered number; ``pos`` is its dense rank in the conversation.
    """
    raw = spark.read.schema(S.FACTOID_TURN).option("multiLine", not lines).json(path)
    turns = raw.select(
        F.col("Conversation_no").alias("seq_id"),
        F.col("Turn_no").alias("turn_no"),
        F.col("Question").alias("text"),
        F.col("Answer").alias("answer"),
        F.col("Topic").alias("label"),
        F.col("Topic_section").alias("section"),
        F.col("Context").alias("context"),
    )
    return dense_positions(turns, ["turn_no"], bucket=F.floor(F.col("turn_no") / 65536))


def read_labelled_dialogs(spark: SparkSession, root: str, splits=("train", "dev", "test")) -> DataFrame:
    """One JSON object per split file ``<root>/<split>/anno_<split>.json``, id to turns."""
    out = None
    for split in splits:
        text = spark.read.text(f"{root}/{split}/anno_{split}.json", wholetext=True)
        part = (
            text.select(F.explode(F.from_json("value", S.LABELLED_DIALOGS)).alias("seq_id", "turns"))
            .select("seq_id", F.posexplode("turns").alias("pos", "turn"))
            .select(
                F.lit(split).alias("split"),
                "seq_id",
                "pos",
                F.col("turn")[0].alias("text"),
                F.col("turn")[1].alias("label"),
            )
        )
        out = part if out is None else out.unionByName(part)
    return out


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated button presses with a header row."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=S.RESPONSES)
    return raw.select(
        F.col("SubjNum").alias("subj"), F.col("Movie").alias("movie"), F.col("MS").alias("ms")
    )


def read_response_curve(spark: SparkSession, path: str) -> DataFrame:
    """Two columns without a header: seconds and response probability."""
    return spark.read.csv(
        path, schema=S.RESPONSE_CURVE, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )


def slice_scenes(scenes: DataFrame, start: int, stop: int, seq_id=None) -> DataFrame:
    """Rows ``start <= pos < stop``; both filters reach the Parquet scan."""
    part = scenes.where((F.col("pos") >= start) & (F.col("pos") < stop))
    return part if seq_id is None else part.where(F.col("seq_id") == F.lit(seq_id))


def first_sequences(turns: DataFrame, n: int) -> DataFrame:
    """Keep the first ``n`` sequences by key, before any expensive step.

    The id list has ``n`` rows, so it is the broadcast side while ``n`` stays small.
    """
    ids = turns.select("seq_id").distinct().orderBy("seq_id").limit(n)
    return turns.join(F.broadcast(ids) if n <= 100_000 else ids, "seq_id", "left_semi")


def user_turns(turns: DataFrame, role: Column | str = "role") -> DataFrame:
    """Questions only; pushed down to the scan."""
    return turns.where((F.col(role) if isinstance(role, str) else role) == "user")
