"""Means and variances per topic: batch, merged, with priors; pretraining and scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from eventide.functions import vector as V
from eventide.functions.vector import LOG_2PI
from eventide.operators.ordered import field_types, matrix
from eventide.operators.positions import join_small
from eventide.operators.segment import WARM_COUNT
from eventide.session import bounded_rows, shuffle_partitions


def topic_moments(scenes: DataFrame, *by: str) -> DataFrame:
    """``<by>, n, mu, m2`` with population sums of squared deviations.

    The summariser keeps one buffer per group and merges buffers map-side, so nothing is
    exploded and a hot group costs one row per map task. Its variance divides by n-1.
    """
    v = array_to_vector(V.as_double("scene"))
    stats = Summarizer.metrics("mean", "variance", "count").summary(v)
    out = scenes.groupBy(*by).agg(stats.alias("s"))
    n = F.col("s.count")
    spread = F.transform(vector_to_array("s.variance"), lambda x: x * (n - 1).cast("double"))
    return out.select(*by, n.alias("n"), vector_to_array("s.mean").alias("mu"), spread.alias("m2"))


def merge_moments(parts: DataFrame, *by: str) -> DataFrame:
    """Merge of partial ``n, mu, m2`` rows (several models or runs) by Chan's formula.

    Deviations are taken from the merged mean, so a common offset of the vectors costs no digits.
    """
    cells = parts.select(
        *by, "n", F.posexplode(F.arrays_zip("mu", "m2")).alias("dim", "c")
    ).select(*by, "n", "dim", F.col("c.mu").alias("mu"), F.col("c.m2").alias("m2"))
    means = cells.groupBy(*by, "dim").agg((F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("_mean"))
    off = F.col("mu") - F.col("_mean")
    sums = join_small(cells, means, [*by, "dim"]).groupBy(*by, "dim").agg(
        F.sum("n").alias("n"),
        # The offsets also mend the rounding of the mean.
        (F.first("_mean") + F.sum(F.col("n") * off) / F.sum("n")).alias("mu"),
        F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"),
    )
    dims = sums.select(*by, "n", F.struct("dim", "mu", "m2").alias("c"))
    rows = dims.groupBy(*by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list("c")).alias("c"))
    return rows.select(
        *by, "n", F.col("c.mu").alias("mu"), F.transform("c.m2", lambda x: F.greatest(x, F.lit(0.0))).alias("m2")
    )


def topic_variance(n: Column, m2: Column, sigma0_sq: float, floor: float = 1e-6) -> Column:
    """Prior variance below three scenes, then population variance with a floor."""
    learned = lambda x: F.greatest(x / n, F.lit(float(floor)))
    return F.transform(m2, lambda x: F.when(n < WARM_COUNT, F.lit(float(sigma0_sq))).otherwise(learned(x)))


def map_variance(n: Column, m2: Column, nu0: float, var0: float) -> Column:
    """Posterior mode of the variance under a scaled-inverse-chi-squared prior, per dimension."""
    return F.transform(m2, lambda x: (F.lit(nu0 * var0) + x) / (F.lit(nu0 + 2.0) + n))


def spherical_map_variance(n: Column, mu: Column, m2: Column, nu0: float, var0: float) -> Column:
    """The same with all dimensions pooled into one sample of ``n * d`` numbers."""
    d = F.size(mu).cast("double")
    grand = V.total(mu) / d
    between = F.aggregate(mu, F.lit(0.0), lambda acc, x: acc + (x - grand) * (x - grand)) * n
    return (F.lit(nu0 * var0) + V.total(m2) + between) / (F.lit(nu0 + 2.0) + n * d)


def pretrain(scenes: DataFrame, *by: str) -> DataFrame:
    """Topic model from labelled scenes: moments of all scenes of a label, its size, and the
    moments of the scenes that open one of its events (``starts``).

    Needs ``label`` and ``is_boundary``. One pass: both summaries share the aggregation.
    """
    v = array_to_vector(V.as_double("scene"))
    zero = F.lit(0.0)
    opening = F.transform(
        V.as_double("scene"), lambda x: F.when(F.col("is_boundary"), x).otherwise(zero)
    )
    out = scenes.groupBy(*by, F.col("label").alias("topic")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(v).alias("s"),
        Summarizer.metrics("sum").summary(array_to_vector(opening)).alias("f"),
        F.count_if("is_boundary").alias("starts"),
    )
    n = F.col("s.count")
    start_mean = F.transform(vector_to_array("f.sum"), lambda x: x / F.col("starts"))
    return out.select(
        *by,
        "topic",
        n.alias("n"),
        vector_to_array("s.mean").alias("mu"),
        F.transform(vector_to_array("s.variance"), lambda x: x * (n - 1).cast("double")).alias("m2"),
        "starts",
        F.when(F.col("starts") > 0, start_mean).alias("start_mu"),
    )


#: Topics of a fitted model that are shipped to every task; larger models are cut into blocks.
MAX_MODEL_TOPICS = 4096
#: Scenes that meet a block of topics in one group, about.
MEETING_ROWS = 32_768


def score_scenes(
    scenes: DataFrame, model: DataFrame, sigma0_sq: float, floor: float = 1e-6,
    keep: tuple[str, ...] = (), max_topics: int = MAX_MODEL_TOPICS,
) -> DataFrame:
    """Best topic of each scene under a fitted model, with its score and log evidence.

    The model (``topic, n, mu, m2``) has one row per topic. Up to ``max_topics`` go to the tasks
    once; a batch of scenes is scored against all of them as one matrix product. A larger model is cut into blocks of
    topics, each scene meets every block, and best topics and evidence merge exactly. The prior is the topic size; the
    lowest topic id wins ties.
    """
    names = ["seq_id", "pos", *keep]
    fields = field_types(scenes, names) + ["topic int", "log_score double", "log_evidence double"]
    size = model.limit(max_topics + 1).count()
    if size <= max_topics:
        table = _model_table(sorted(bounded_rows(model.select("topic", "n", "mu", "m2"), max_topics, "topic model")), sigma0_sq, floor)

        def run(batches):
            for batch in batches:
                out = [batch.column(c) for c in names] + _scored(matrix(batch.column("scene")), table)
                yield pa.RecordBatch.from_arrays(out, names=names + ["topic", "log_score", "log_evidence"])

        return scenes.select(*names, "scene").mapInArrow(run, ", ".join(fields))
    # Equal rows are scored once and returned as often as they came, as on the other route.
    given = scenes.groupBy(*names, "scene").agg(F.count("*").alias("_copies")).withColumn("_id", F.xxhash64(*names, "scene"))
    keyed_by = [*names, "_copies", "_id"]
    fields = field_types(given, keyed_by) + fields[len(names):]
    blocks = model.count() // max_topics + 1
    part = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    salts = max(shuffle_partitions(scenes.sparkSession), scenes.count() // MEETING_ROWS + 1)
    salt = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    left = given.select(*keyed_by, "scene", F.pmod("_id", F.lit(salts)).alias("_q"), F.explode(part).alias("_v"))
    right = model.select("topic", "n", "mu", "m2", F.pmod(F.xxhash64("topic"), F.lit(blocks)).alias("_v")).withColumn("_q", F.explode(salt))

    def meet(own: pa.Table, topics: pa.Table) -> pa.Table:
        keyed = [own.schema.field(c) for c in keyed_by]
        schema = pa.schema(keyed + [("topic", pa.int32()), ("log_score", pa.float64()), ("log_evidence", pa.float64())])
        if not own.num_rows or not topics.num_rows:
            return schema.empty_table()
        rows = sorted(topics.select(["topic", "n", "mu", "m2"]).to_pylist(), key=lambda r: r["topic"])
        table = _model_table(rows, sigma0_sq, floor)
        parts = []
        for batch in own.to_batches(max_chunksize=2048):
            columns = [batch.column(c) for c in keyed_by] + _scored(matrix(batch.column("scene")), table)
            parts.append(pa.RecordBatch.from_arrays(columns, schema=schema))
        return pa.Table.from_batches(parts, schema)

    met = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(meet, ", ".join(fields))
    merged = met.groupBy(*keyed_by).agg(
        F.max_by("topic", F.struct(F.col("log_score"), -F.col("topic"))).alias("topic"), F.max("log_score").alias("log_score"),
        F.max("log_evidence").alias("_m"), F.collect_list("log_evidence").alias("_e"),
    )
    mass = F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + F.exp(e - F.col("_m")))
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    best = merged.select(*names, "topic", "log_score", (F.col("_m") + F.log(mass)).alias("log_evidence"), copies.alias("_copy"))
    return best.drop("_copy")


def _model_table(rows: list, sigma0_sq: float, floor: float) -> tuple[np.ndarray, ...]:
    """Topics, log sizes, centre, and the terms of the Gaussian scores about that centre."""
    topics = np.array([r["topic"] for r in rows], dtype=np.int32)
    n = np.array([r["n"] for r in rows], dtype=np.float64)
    mu = np.array([r["mu"] for r in rows])
    var = np.maximum(np.array([r["m2"] for r in rows]) / n[:, None], floor)
    var[n < WARM_COUNT] = sigma0_sq
    centre = mu.mean(axis=0)
    mu = mu - centre
    inv = 1.0 / var
    return topics, np.log(n), centre, inv, mu * inv, (mu * mu * inv + np.log(var)).sum(axis=1) + mu.shape[1] * LOG_2PI


def _scored(x: np.ndarray, table: tuple[np.ndarray, ...]) -> list[pa.Array]:
    """Best topic, its score and the evidence. Squares are taken about the topics' centre, so an offset costs no digits."""
    topics, log_n, centre, inv, weighted, const = table
    if not len(x):
        return [pa.array([], pa.int32()), pa.array([], pa.float64()), pa.array([], pa.float64())]
    x = x - centre
    score = -0.5 * ((x * x) @ inv.T - 2.0 * x @ weighted.T + const) + log_n
    best = score.argmax(axis=1)
    top = score[np.arange(len(x)), best]
    evidence = top + np.log(np.exp(score - top[:, None]).sum(axis=1))
    return [pa.array(topics[best], pa.int32()), pa.array(top), pa.array(evidence)]
