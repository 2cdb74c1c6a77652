"""Threshold sweeps and first-wins selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from eventide.operators.metrics import with_f1


def arange(start: float, stop: float, step: float) -> list[float]:
    """Thresholds with the accumulated float error of ``numpy.arange``; strict tests near a
    threshold depend on it, so they are computed once and shipped as literals."""
    return [float(t) for t in np.arange(start, stop, step)]


def _cleared(score: Column, thetas: list[float]) -> Column:
    """How many of the ascending thresholds the score reaches (``theta <= score``).

    NULL for a NULL score: such a transition is neither predicted nor missed at any threshold.
    """
    reached = F.filter(F.array(*map(F.lit, thetas)), lambda t: t <= score)
    return F.when(score.isNotNull(), F.size(reached))


def threshold_sweep(
    transitions: DataFrame, thetas: list[float], score: str = "score", by: tuple[str, ...] = ()
) -> DataFrame:
    """P, R and F1 of ``score < theta`` for every threshold, in one pass.

    Transitions are counted by the first threshold above them, and running totals over the
    (number of thresholds + 1) buckets give every confusion table. The cost does not grow
    with the number of thresholds and only counts are shuffled. ``by`` gives one sweep per
    group. A NULL score counts in none of tp, fp and fn.
    """
    order = sorted(range(len(thetas)), key=lambda i: thetas[i])
    ascending = [thetas[i] for i in order]
    counts = transitions.groupBy(*by, _cleared(F.col(score), ascending).alias("bucket")).agg(
        F.count_if("gt").alias("pos"), F.count_if(~F.col("gt")).alias("neg")
    )
    # At most one small struct per threshold and group.
    packed = counts.groupBy(*by).agg(F.collect_list(F.struct("bucket", "pos", "neg")).alias("c"))
    grid = F.array(
        *[
            F.struct(F.lit(b).alias("bucket"), F.lit(order[b]).alias("theta_id"), F.lit(t).alias("theta"))
            for b, t in enumerate(ascending)
        ]
    )
    cells = packed.select(*by, "c", F.explode(grid).alias("g"))

    def add_up(field: str, keep) -> Column:
        kept = F.filter("c", lambda x: keep(x["bucket"]))
        return F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, x: acc + x[field])

    through = lambda bucket: bucket <= F.col("g.bucket")
    beyond = lambda bucket: bucket > F.col("g.bucket")
    return with_f1(
        cells.select(
            *by, "g.theta_id", "g.theta",
            add_up("pos", through).alias("tp"), add_up("neg", through).alias("fp"),
            add_up("pos", beyond).alias("fn"),
        )
    )


def first_best(rows: DataFrame, score: str, order: str, *by: str) -> DataFrame:
    """The row with the highest score; on ties the lowest ``order`` wins."""
    best = F.max_by(
        F.struct(*[c for c in rows.columns if c not in by]),
        F.struct(F.col(score), -F.col(order)),
    )
    return rows.groupBy(*by).agg(best.alias("_best")).select(*by, "_best.*")


def top_configs(rows: DataFrame, k: int, score: str = "f1", order: str = "cfg_id") -> DataFrame:
    """The ``k`` best rows, stable in sweep order."""
    return rows.orderBy(F.desc(score), F.asc(order)).limit(k)
