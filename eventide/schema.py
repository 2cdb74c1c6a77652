"""Table schemas and the checks that replace implicit, unchecked dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

#: Turns of a factoid dialogue as delivered (JSON array of objects).
FACTOID_TURN = T.StructType(
    [
        T.StructField("Conversation_no", T.LongType()),
        T.StructField("Turn_no", T.IntegerType()),
        T.StructField("Question", T.StringType()),
        T.StructField("Answer", T.StringType()),
        T.StructField("Rationale", T.StringType()),
        T.StructField("Topic", T.StringType()),
        T.StructField("Topic_section", T.StringType()),
        T.StructField("Context", T.ArrayType(T.StringType())),
        T.StructField("is_nq", T.BooleanType()),
    ]
)

#: Dialogs keyed by id: list of [utterance, label].
LABELLED_DIALOGS = T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.StringType())))

RESPONSES = T.StructType(
    [
        T.StructField("SubjNum", T.IntegerType()),
        T.StructField("Movie", T.StringType()),
        T.StructField("MS", T.DoubleType()),
    ]
)

RESPONSE_CURVE = T.StructType(
    [T.StructField("t_sec", T.DoubleType()), T.StructField("p", T.DoubleType())]
)


def scene_quality(scenes: DataFrame) -> DataFrame:
    """One row: row count, smallest and largest dimension, whether positions are dense."""
    per_seq = scenes.groupBy("seq_id").agg(
        F.count("*").alias("n"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
        F.min(F.size("scene")).alias("min_dim"),
        F.max(F.size("scene")).alias("max_dim"),
    )
    return per_seq.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_sequences"),
        F.min("min_dim").alias("min_dim"),
        F.max("max_dim").alias("max_dim"),
        F.bool_and((F.col("first") == 0) & (F.col("last") == F.col("n") - 1)).alias("dense"),
    )
