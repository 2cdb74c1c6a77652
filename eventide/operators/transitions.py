"""Transitions between neighbouring rows: truth, cosine, overlap, boundary flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventide.functions import text as X, vector as V
from eventide.operators.positions import BLOCK_ROWS, with_lag


def label_shifts(turns: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Truth by label change; N turns give N-1 rows and sections do not count."""
    lagged = with_lag(turns.select("seq_id", "pos", "label"), {"_prev": "label"}, rows)
    return lagged.where(F.col("pos") > 0).select(
        "seq_id", "pos", (~F.col("label").eqNullSafe(F.col("_prev"))).alias("gt")
    )


def flagged_shifts(turns: DataFrame, flag: str = "1") -> DataFrame:
    """Truth by a label that marks the shift itself; no lag, no shuffle."""
    return turns.where(F.col("pos") > 0).select(
        "seq_id", "pos", F.coalesce(F.col("label") == flag, F.lit(False)).alias("gt")
    )


def scored_transitions(
    turns: DataFrame, score: str, source: str, rows: int = BLOCK_ROWS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``seq_id, pos, gt, score`` with score ``cosine``, ``jaccard`` or ``dot`` of neighbours.

    Truth and score come from one pass over the same windows, so nothing is joined.
    """
    lagged = with_lag(
        turns.select("seq_id", "pos", *keep, "label", source), {"_label": "label", "_src": source}, rows
    ).where(F.col("pos") > 0)
    return lagged.select(
        "seq_id",
        "pos",
        *keep,
        (~F.col("label").eqNullSafe(F.col("_label"))).alias("gt"),
        _SCORES[score](F.col(source), F.col("_src")).alias("score"),
    )


_SCORES = {
    # Unit vectors: the cosine of neighbours is their dot product.
    "dot": lambda a, b: V.dot(V.as_double(a), V.as_double(b)),
    "cosine": lambda a, b: V.cosine(V.as_double(a), V.as_double(b)),
    "jaccard": X.jaccard,
}


def boundary_flags(assigned: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``is_boundary`` from topic ids; false on the first row of a sequence."""
    lagged = with_lag(assigned, {"_prev": "topic"}, rows)
    flag = F.coalesce(F.col("topic") != F.col("_prev"), F.lit(False))
    return lagged.select(*assigned.columns, flag.alias("is_boundary"))


def all_boundary(transitions: DataFrame) -> DataFrame:
    return transitions.withColumn("pred", F.lit(True))


def below(transitions: DataFrame, theta: float, score: str = "score") -> DataFrame:
    """Predict a shift where the score is strictly below ``theta``."""
    return transitions.withColumn("pred", F.col(score) < F.lit(float(theta)))


def drop_first(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("pos") > 0)


def prediction_error_ratio(errors: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``pe`` and its ratio to the previous scene's error."""
    lagged = with_lag(errors, {"_prev": "pe"}, rows)
    ratio = F.when(F.col("_prev") > 0, F.col("pe") / F.col("_prev"))
    return lagged.select(*errors.columns, ratio.alias("pe_ratio"))


def pooled(columns: list[Column]) -> Column:
    """Sum of a list of numeric Columns (kept here to avoid Python's ``sum`` start value)."""
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out
