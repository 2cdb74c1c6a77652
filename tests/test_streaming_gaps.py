"""A lost position doesn't hold back the rest of its sequence, and rows without a place aren't lost."""

import pytest
from pyspark.sql import functions as F

from eventide.operators import segment as G
from eventide.plans import catalog
from eventide.plans.q_segment import MIXED


def test_lost_repeated_and_null_positions(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    dense = table.where(~F.col("vec_id").isin(3, 6, 20))  # inside a sequence, twice, and at the start of another
    odd = table.where("vec_id = 31").union(table.where("vec_id = 40").withColumn("vec_id", F.lit(None).cast("long")))
    dense.union(odd).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.warns(UserWarning, match="2 late, repeated or unplaced rows are in") as said:
        got = catalog.QUERIES["stream_segment"](spark, str(tmp_path)).collect()
    scenes = dense.select(F.expr("vec_id div 10").alias("seq_id"), (F.col("vec_id") % 10).alias("pos"), F.col("embedding").alias("scene"))
    want = G.segment(scenes, MIXED).collect()
    assert sorted((r.seq_id, r.pos, r.topic, r.is_boundary) for r in got) == sorted((r.seq_id, r.pos, r.topic, r.is_boundary) for r in want)
    path = next(str(w.message).split(" are in ")[1] for w in said if "unplaced" in str(w.message))
    assert sorted(((r.seq_id, r.pos) for r in spark.read.parquet(path).collect()), key=repr) == [(3, 1), (None, None)]
