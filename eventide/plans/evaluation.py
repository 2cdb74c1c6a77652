"""The evaluations: baselines and segmenters scored against shift truth, as one report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from eventide.operators import metrics, sweep, transitions as T
from eventide.operators.context import contextualized
from eventide.operators.encode import encode
from eventide.operators.segment import (
    FREQUENT_SHIFT, PERSISTENCE, Config, config_table, grid_scores, segment, with_truth,
)

COUNTS = ("tp", "fp", "fn")
SCORES = ("precision", "recall", "f1")


def method_table(
    scenes: DataFrame, thetas: Sequence[float], segmenters: dict[str, Config], flag: str | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """``method, theta, tp, fp, fn, precision, recall, f1`` for every method.

    Two passes over the scenes: one for everything that follows from neighbour scores (the
    all-boundary baseline is the threshold that nothing reaches), one for the segmenters.
    """
    tr = T.scored_transitions(scenes, "dot", "scene", keep=by)
    if flag is not None:
        tr = tr.drop("gt").join(T.flagged_shifts(scenes, flag), ["seq_id", "pos"])
    every = float("inf")
    swept = sweep.threshold_sweep(tr, [*thetas, every], by=by)
    row = F.struct("theta", *COUNTS, *SCORES)
    real = F.col("theta") != every
    best = F.max_by(row, F.when(real, F.struct("f1", (-F.col("theta_id")).alias("o"))))
    named = lambda name, r, theta: F.struct(
        F.lit(name).alias("method"), theta.alias("theta"), *[r[c].alias(c) for c in COUNTS + SCORES]
    )
    none = F.lit(None).cast("double")
    both = swept.groupBy(*by).agg(best.alias("b"), F.max(F.when(~real, row)).alias("a")).select(
        *by,
        F.explode(
            F.array(
                named("all-boundary", F.col("a"), none),
                named("cosine-threshold", F.col("b"), F.col("b.theta")),
            )
        ).alias("m"),
    )
    names = F.array(*map(F.lit, segmenters))
    scored = grid_scores(scenes, list(segmenters.values()), flag=flag, by=by)
    method = F.element_at(names, F.col("cfg_id") + 1)
    return both.select(*by, "m.*").unionByName(
        scored.select(*by, method.alias("method"), none.alias("theta"), *COUNTS, *SCORES)
    )


def report(scenes: DataFrame, thetas: Sequence[float], segmenters: dict[str, Config]) -> DataFrame:
    """Data counts, method rows and gate rows as ``section, item, value``.

    The method table has a handful of rows; they are packed into one, so that all sections
    read the same result and nothing is computed twice.
    """
    methods = method_table(scenes, thetas, segmenters)
    packed = methods.agg(F.collect_list(F.struct("method", "tp", "fp", *SCORES)).alias("m"))
    of = lambda name: F.element_at(F.filter("m", lambda r: r["method"] == name), 1)
    cell = lambda section, item, value: F.struct(
        F.lit(section).alias("section"), item.alias("item"), value.cast("double").alias("value")
    )
    base = of("all-boundary")
    data = F.array(
        cell("data", F.lit("transitions"), base["tp"] + base["fp"]),
        cell("data", F.lit("shifts"), base["tp"]),
        cell("data", F.lit("shift_rate"), base["precision"]),
    )

    def score_cells(score: str):
        named = lambda r: cell("method", F.concat(r["method"], F.lit("/" + score)), r[score])
        return F.transform("m", named)

    scores = [score_cells(s) for s in SCORES]
    gates = F.array(
        *[
            cell("gate", F.lit(n), metrics.passes(of(n)["f1"], of("cosine-threshold")["f1"]))
            for n in segmenters
        ]
    )
    return packed.select(F.explode(F.concat(data, *scores, gates)).alias("r")).select("r.*")


def context_sweep(
    asked: DataFrame, windows: Sequence[int | str], thetas: Sequence[float], d: int = 64
) -> DataFrame:
    """Per context window: mean characters, best threshold and F1, and the F1 of both
    published parameter pairs. Needs ``label`` per question.

    The windows become groups of one table, so texts are encoded and scored in one job each.
    """
    texts = None
    for k in windows:
        rows = contextualized(asked, k).select(
            F.lit(str(k)).alias("k"), F.concat_ws(":", F.lit(str(k)), "seq_id").alias("seq_id"),
            "pos", "label", "context",
        )
        texts = rows if texts is None else texts.unionByName(rows)
    chars = texts.groupBy("k").agg(F.avg(F.length("context")).alias("mean_chars"))
    scenes = encode(texts, "context", d=d)
    table = method_table(
        scenes, thetas, {"frequent": FREQUENT_SHIFT, "persistent": PERSISTENCE}, by=("k",)
    )
    pick = lambda name, c: F.max(F.when(F.col("method") == name, F.col(c)))
    wide = table.groupBy("k").agg(
        pick("cosine-threshold", "theta").alias("theta"),
        pick("cosine-threshold", "f1").alias("cosine_f1"),
        pick("frequent", "f1").alias("frequent_f1"),
        pick("persistent", "f1").alias("persistent_f1"),
    )
    return chars.join(wide, "k")


def best_by_scorer(scenes: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """First best configuration of each scorer."""
    table = config_table(scenes.sparkSession, configs)
    scored = grid_scores(scenes, configs).join(F.broadcast(table), "cfg_id")
    return sweep.first_best(scored, "f1", "cfg_id", "scorer")


def top_of_grid(scenes: DataFrame, configs: Sequence[Config], k: int) -> DataFrame:
    table = config_table(scenes.sparkSession, configs)
    return sweep.top_configs(grid_scores(scenes, configs).join(F.broadcast(table), "cfg_id"), k)


def encoder_sweep(turns: DataFrame, dims: Sequence[int], thetas: Sequence[float]) -> DataFrame:
    """The evaluation repeated for several encoders (here: sizes of the hashed encoder)."""
    out = None
    for d in dims:
        scenes = encode(turns, "text", d=d)
        rows = method_table(
            scenes, thetas,
            {"frequent": FREQUENT_SHIFT, "persistent": PERSISTENCE},
        ).select(F.lit(d).alias("encoder"), "method", "f1")
        out = rows if out is None else out.unionByName(rows)
    return out


def shift_f1(scenes: DataFrame, config: Config) -> DataFrame:
    return metrics.f1_score(with_truth(segment(scenes, config, keep=["label"])))
