"""Mixing sources to target weights by entropy balancing.

Every document gets a rate. Of all rates with which the words of each source add up to the source's target,
and which are at most ``MOST`` copies, the ones closest in relative entropy to one copy each are
``min(MOST, exp(lambda_source * size))``: exponentially tilted by size. ``lambda_source`` solves a one-dimensional dual
equation per source, found by Newton steps in which Spark sums over all documents of all sources at once. The sums run over
the histogram (source, size, number of documents), which partial aggregation builds in one pass over the texts.

Rates become whole copies: per size class, by rounding running totals from the longest documents down, so that the
error of a source stays below its longest document, then by adding or taking back single copies where that brings the
source nearer to its target. Inside a class the copies go round-robin by a hash of the document's id. Tilts are rounded to ten digits, so that the
order in which tasks add up numbers doesn't show; reruns agree.

Defined cases: a null or empty text has size 0 and takes nothing. A null source is a source of its own. Repeated rows
count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.positions import dense_positions
from .common import iterate, n_words, safe_join, table, written

MOST = 2
SHARE = 1.5
WEIGHTS = (3, 1, 2)
#: Relative miss of a target at which Newton's steps end; whole copies are coarser than that.
CLOSE = 1e-6
NEWTON_ROUNDS = 40
MENDING_ROUNDS = 5
BUCKETS = 256


def capped_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of the sources: ``share`` of all words by weight, at most ``most`` times a source's words.

    ``totals`` has a row per source (``source``, ``source_size``). Weights repeat over the sources in code point order,
    null last. Raising a common level caps the sources in the order of cap per weight, so that running sums in
    this order tell which are capped, without repeated resharing.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = totals.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size").cast("double") * most)
    whole = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    order = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.select(
        "*",
        F.row_number().over(by_cap).alias("turn"),
        (F.sum(F.col("source_size").cast("double")).over(whole) * share - F.coalesce(F.sum("cap").over(order), F.lit(0.0))).alias("words_left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))).alias("weight_left"),
    )
    first_free = F.min(F.when(~F.col("capped"), F.struct("turn", (F.col("words_left") / F.col("weight_left")).alias("level"))))
    level = first_free.over(whole)["level"]
    return left.withColumn("capped", F.col("cap") / F.col("weight") * F.col("weight_left") <= F.col("words_left")).select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target")
    )


def _tilts(classes: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """``lambda`` per source by Newton steps; a step that leaves the bracket is replaced by bisection.

    Sizes count in units of the source's mean. Below the words of a source the dual is convex and Newton's steps
    from 0 come down to the root; above, it is bracketed by 0 and the tilt at which even the shortest document is capped.
    """
    unit = F.col("source_size") / F.col("docs")
    start = sources.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * most)).select(
        "source", "target", unit.alias("unit"), F.lit(0.0).alias("tilt"),
        F.when(F.col("target") > F.col("source_size"), 0.0).otherwise(float("-inf")).alias("low"),
        F.when(F.col("target") > F.col("source_size"), math.log(most) * unit / F.col("shortest")).otherwise(0.0).alias("high"),
        F.lit(1.0).alias("miss"),
    )

    def step(state: DataFrame) -> DataFrame:
        x = F.col("size") / F.col("unit")
        rate = F.exp(F.col("tilt") * x)
        free = rate < most
        sums = (
            safe_join(classes, state, ["source"], "inner")
            .groupBy("source", "target", "unit", "tilt", "low", "high")
            .agg(
                F.sum(F.col("n") * F.col("size") * F.when(free, rate).otherwise(float(most))).alias("got"),
                F.sum(F.when(free, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("target") - F.col("got")
        low = F.when(gap > 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.least("high", "tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") + F.try_divide(gap, F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("low2")) & (newton < F.col("high2"))
        middle = F.when(F.col("low2") == float("-inf"), F.col("high2") * 2 - 1).otherwise((F.col("low2") + F.col("high2")) / 2)
        return sums.select("*", low.alias("low2"), high.alias("high2")).select(
            "source", "target", "unit",
            F.when(F.abs(gap) <= F.col("target") * CLOSE, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"),
            F.col("low2").alias("low"), F.col("high2").alias("high"), (F.abs(gap) / F.col("target")).alias("miss"),
        )

    return iterate(written(start, "mix-tilt"), step, NEWTON_ROUNDS, "mix-tilt", lambda s: s.where(F.col("miss") > CLOSE))


def _mended(classes: DataFrame, most: int) -> DataFrame:
    """Add or take back one copy in one size class per source while that brings the source nearer to its target."""
    state = written(classes.withColumn("moved", F.lit(True)), "mix-copies")
    for _ in range(MENDING_ROUNDS):
        gaps = state.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        after = F.abs(F.abs(F.col("gap")) - F.col("size"))
        can = F.when(F.col("gap") > 0, F.col("copies") < F.col("n") * most).otherwise(F.col("copies") > 0) & (after < F.abs(F.col("gap")))
        best = (
            safe_join(state, gaps, ["source"], "inner").where(can)
            .groupBy("source").agg(F.min_by(F.struct(F.col("size"), F.signum("gap").cast("long").alias("by")), F.struct(after, F.col("size"))).alias("best"))
            .select("source", "best.size", "best.by")
        )
        moved = written(best, "mix-moves")
        if moved.isEmpty():
            break
        state = written(
            safe_join(state, moved, ["source", "size"]).withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("by"), "mix-copies"
        )
    return state


def mixed(docs: DataFrame, size: Column, targets=capped_targets, most: int = MOST, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` per document.

    ``docs`` has ``source`` and ``key``; ``targets`` makes ``target`` from (``source``, ``source_size``).
    """
    sized = written(docs.select(key, "source", size.alias("size")), "mix-sizes")
    classes = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    classes = written(classes, "mix-classes")
    totals = classes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("shortest")
    )
    sources = written(safe_join(targets(totals.select("source", "source_size")), totals.drop("source_size"), ["source"]), "mix-sources")
    tilts = _tilts(classes, sources, most)
    rate = F.when(F.col("target") >= F.col("source_size") * most, float(most)).when(F.col("target") <= 0, 0.0).otherwise(
        F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("unit")))
    )
    rated = safe_join(
        safe_join(classes.where("size > 0"), sources.select("source", "target", "source_size"), ["source"]), tilts.select("source", F.round("tilt", 10).alias("tilt"), "unit"), ["source"]
    ).withColumn("rate", rate)
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.col("n") * F.col("rate")).over(down)
    copies = F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("n") * F.col("rate") + 0.5)
    rounded = rated.withColumn("run", running).withColumn("copies", F.least(F.greatest(copies, F.lit(0)), F.col("n") * most).cast("long"))
    classes_out = _mended(rounded.select("source", "size", "n", "target", "rate", "copies"), most)
    spread = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    ranked = dense_positions(sized.withColumn("seq_id", F.struct("source", "size")), [F.xxhash64(key), key], spread).drop("seq_id")
    out = safe_join(ranked, classes_out.select("source", "size", "n", "rate", F.col("copies").alias("k")), ["source", "size"])
    out = safe_join(out, sources.select("source", "source_size", "target"), ["source"])
    own = F.expr("k div n") + F.when(F.col("pos") < F.col("k") % F.col("n"), 1).otherwise(0)
    return out.select(key, "source", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce(own, F.lit(0)).cast("long").alias("copies"))


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs, n_words(F.col("text"))).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document that it leaves out goes.

    Rows of one id share a decision only if they share source and size, so the join is on all three.
    """
    out = mixed(docs.select("doc_id", "source", "text"), n_words(F.col("text")))
    per_key = out.groupBy("doc_id", "source", F.col("size").alias("__size")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    keyed = docs.withColumn("__size", n_words(F.col("text")))
    joined = safe_join(keyed, per_key, ["doc_id", "source", "__size"])
    each = F.expr("cast(ceil(__copies / __rows) as int)")
    return joined.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), each))).select(*docs.columns)
