"""Noisy memory traces: corruption, matching to time slots, fusion, reconstruction scores.

A trace is ``seq_id, trace_id, x, e, t``: features, an event label that may be NULL, and a
noisy time. All draws are functions of the row's key (see :mod:`eventide.functions.hashed`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from eventide.functions import hashed as H, vector as V
from eventide.operators.positions import join_small, meet


def corrupt(scenes: DataFrame, tau: float, label_precision: float, b: int, seed: str = "0") -> DataFrame:
    """Traces of scenes (``seq_id, pos, scene, label``): Gaussian noise of variance ``tau``,
    labels kept with probability ``label_precision``, time moved by up to ``b`` either way."""
    key = lambda *parts: H.key(seed, F.col("seq_id"), F.col("pos"), *parts)
    noise = lambda i: H.normal(key("x", i)) * float(tau) ** 0.5
    x = F.transform(V.as_double("scene"), lambda v, i: v + noise(i))
    keep = H.uniform(key("e")) < label_precision
    return scenes.select(
        "seq_id",
        F.col("pos").alias("trace_id"),
        x.alias("x"),
        F.when(keep, F.col("label")).alias("e"),
        (F.col("pos") + H.integer(H.uniform(key("t")), -b, b)).cast("int").alias("t"),
    )


def match_slots(traces: DataFrame, slots: DataFrame, b: int) -> DataFrame:
    """Traces against the time slots within ``b`` of them, labels permitting.

    The band is turned into an equality: a trace is repeated for each of its ``2b+1`` slots,
    so the join hashes on (sequence, slot) and a long sequence spreads over tasks. A label
    must be NULL or equal to the label of the slot that is being filled.
    """
    near = traces.withColumn("pos", F.explode(F.sequence(F.col("t") - b, F.col("t") + b)))
    joined = meet(near, slots.select("seq_id", "pos", F.col("scene").alias("_scene"), F.col("label").alias("_label")), ["seq_id", "pos"])
    return joined.where(F.col("e").isNull() | (F.col("e") == F.col("_label")))


def trace_posterior(traces: DataFrame, slots: DataFrame, b: int, tau: float, epsilon: float) -> DataFrame:
    """``seq_id, pos, trace_id, log_p``: weight of each trace for each slot.

    Every slot also has a null trace (NULL id) of weight ``epsilon``. A slot sees few traces,
    so normalising is a window over (sequence, slot) on the join's own partitioning.
    """
    d = F.size("x")
    score = (V.squared_distance(F.col("x"), V.as_double("_scene")) / float(tau)
             + d * (V.LOG_2PI + F.log(F.lit(float(tau))))) * -0.5
    matched = match_slots(traces, slots, b).select("seq_id", "pos", "trace_id", score.alias("score"))
    null_id = F.lit(None).cast(dict(traces.dtypes)["trace_id"])
    nulls = slots.select("seq_id", "pos", null_id.alias("trace_id"), F.log(F.lit(float(epsilon))).alias("score"))
    rows = matched.unionByName(nulls)
    slot = Window.partitionBy("seq_id", "pos")
    peak = rows.withColumn("_m", F.max("score").over(slot))
    z = F.col("_m") + F.log(F.sum(F.exp(F.col("score") - F.col("_m"))).over(slot))
    return peak.select("seq_id", "pos", "trace_id", (F.col("score") - z).alias("log_p"))


def draw_traces(posterior: DataFrame, n_samples: int, seed: str = "0") -> DataFrame:
    """``sample_id, seq_id, pos, trace_id``: one trace per slot and sample, drawn by its
    weight (Gumbel maximum over hash-seeded noise); NULL is the null trace."""
    samples = posterior.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    noise = H.gumbel(
        H.key(seed, F.col("sample_id"), F.col("seq_id"), F.col("pos"), F.coalesce(F.col("trace_id").cast("string"), F.lit("null")))
    )
    best = F.max_by(F.struct("trace_id"), F.col("log_p") + noise)
    return samples.groupBy("sample_id", "seq_id", "pos").agg(best.alias("_b")).select(
        "sample_id", "seq_id", "pos", F.col("_b.trace_id").alias("trace_id")
    )


def recall(samples: DataFrame, traces: DataFrame, n_samples: int) -> DataFrame:
    """Per original trace the share of samples that contain exactly its features.

    ``samples`` has ``sample_id, seq_id, x``. Matching is a semi-join style equality on the
    features (hash first, so the vectors are compared only within equal hashes); null slots
    never match.
    """
    held = samples.where(F.col("x").isNotNull()).select(
        "sample_id", "seq_id", F.xxhash64("x").alias("h"), F.col("x").alias("_x")
    )
    mine = traces.select("seq_id", "trace_id", F.xxhash64("x").alias("h"), "x")
    # Equal traces of a sample count once, so the join cannot multiply.
    found = (
        meet(mine, held.dropDuplicates(["sample_id", "seq_id", "h", "_x"]), ["seq_id", "h"])
        .where(F.col("x") == F.col("_x"))
        .groupBy("seq_id", "trace_id")
        .agg(F.count_distinct("sample_id").alias("hits"))
    )
    joined = join_small(traces.select("seq_id", "trace_id"), found, ["seq_id", "trace_id"])
    return joined.select(
        "seq_id", "trace_id", (F.coalesce("hits", F.lit(0)) / F.lit(float(n_samples))).alias("recall")
    )


def fuse_traces(filled: DataFrame, tau: float) -> DataFrame:
    """Mean and variance of each slot from the model (``mu, var``) and its trace (``x``).

    A slot without a trace keeps the model's prediction.
    """
    mean, var = V.fuse(F.col("mu"), F.col("x"), F.col("var"), tau)
    empty = F.col("x").isNull()
    return filled.select(
        *[c for c in filled.columns if c not in ("mu", "var", "x")],
        F.when(empty, F.col("mu")).otherwise(mean).alias("mean"),
        F.when(empty, F.col("var")).otherwise(var).alias("variance"),
    )


def centroids(scenes: DataFrame, *by: str) -> DataFrame:
    from eventide.operators.moments import topic_moments

    return topic_moments(scenes, *by).select(*by, F.col("mu").alias("centroid"))


def relative_distance(rebuilt: DataFrame, scenes: DataFrame, *by: str) -> DataFrame:
    """Mean of (distance to the centroid of the event) - (distance to the true scene).

    Positive values mean that a reconstruction is drawn to the scene and not to the event's
    average. ``rebuilt`` has ``<by>, seq_id, pos, mean``; ``scenes`` has a label.
    """
    truth = join_small(
        scenes.select("seq_id", "pos", "label", V.as_double("scene").alias("scene")), centroids(scenes, "label"), ["label"]
    )
    joined = meet(rebuilt, truth, ["seq_id", "pos"])
    to_truth = V.euclidean(F.col("mean"), F.col("scene"))
    to_centroid = V.euclidean(F.col("mean"), F.col("centroid"))
    return joined.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.avg(to_truth).alias("error"),
        F.avg(to_centroid - to_truth).alias("relative_distance"),
    )
