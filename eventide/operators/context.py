"""Context of a turn: earlier question/answer pairs, sliding windows of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from eventide.functions import text as X, vector as V
from eventide.operators.positions import (
    BLOCK_ROWS, dense_positions, halo_window, with_carry, with_halo,
)


def questions(turns: DataFrame, asker: str = "user", answerer: str = "assistant",
              rows: int = BLOCK_ROWS) -> DataFrame:
    """``seq_id, pos, turn, text, answer``: each question with the reply that follows it.

    ``pos`` is the rank of the question in its dialogue; an unanswered one gets ''.
    """
    haloed, own = with_halo(turns.select("seq_id", "pos", "label", "text"), 0, rows, after=1)
    w = halo_window()
    ahead = haloed.select(
        "*", F.lead("label").over(w).alias("_role"), F.lead("text").over(w).alias("_reply")
    ).where(own & (F.col("label") == asker))
    replied = ahead.select(
        "seq_id",
        F.col("pos").alias("turn"),
        "text",
        F.when(F.col("_role") == answerer, F.col("_reply")).otherwise(F.lit("")).alias("answer"),
    )
    return dense_positions(replied, ["turn"], bucket=F.floor(F.col("turn") / rows))


def contextualized(asked: DataFrame, k: int | str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``context``: the last ``k`` pairs (or ``"all"``) and then the current question.

    For a number, each block borrows ``k`` rows from the one before. For ``"all"`` the text
    of earlier blocks is carried as one string; its size is the size of the result itself.
    """
    pair = X.exchange(F.col("text"), F.col("answer"))
    asking = X.question(F.col("text"))
    if k == "all":
        ordered = F.array_sort(F.collect_list(F.struct("pos", pair.alias("x"))))
        block_text = F.array_join(F.transform(ordered, lambda r: r["x"]), " ")
        joined, w = with_carry(
            asked,
            ["seq_id"],
            {"_block_text": block_text},
            lambda before, _: {"_earlier": F.array_join(F.collect_list("_block_text").over(before), " ")},
            rows,
        )
        inside = F.collect_list(pair).over(w.rowsBetween(Window.unboundedPreceding, -1))
        earlier = F.filter(F.array(F.col("_earlier")), lambda t: t != "")
        parts = F.concat(F.coalesce(earlier, F.array().cast("array<string>")), "_inside", F.array(asking))
        return joined.select(*asked.columns, inside.alias("_inside"), "_earlier").select(
            *asked.columns, F.array_join(parts, " ").alias("context")
        )
    if int(k) == 0:
        return asked.withColumn("context", asking)
    haloed, own = with_halo(asked, int(k), rows)
    inside = F.collect_list(pair).over(halo_window().rowsBetween(-int(k), -1))
    framed = haloed.select("*", inside.alias("_inside")).where(own)
    return framed.select(
        *asked.columns, F.array_join(F.concat("_inside", F.array(asking)), " ").alias("context")
    )


def unroll(scenes: DataFrame, t: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``window``: the last ``t`` scenes including the current one, zeros on the left."""
    haloed, own = with_halo(scenes, t - 1, rows)
    seen = F.collect_list(V.as_double("scene")).over(halo_window().rowsBetween(-(t - 1), 0))
    framed = haloed.select("*", seen.alias("_seen")).where(own)
    zeros = F.transform(V.as_double("scene"), lambda _: F.lit(0.0))
    padding = F.array_repeat(zeros, F.lit(t) - F.size("_seen"))
    return framed.select(*scenes.columns, F.concat(padding, "_seen").alias("window"))
