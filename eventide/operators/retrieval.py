"""Reading the long-term store: relevant topics and turns, topic importance, recognition, topic merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventide.functions import vector as V
from eventide.operators.moments import merge_moments, topic_moments
from eventide.operators.near import components, near_pairs
from eventide.operators.positions import BLOCK, BLOCK_ROWS, block_of, join_small, meet, with_lag


def topic_metadata(scenes: DataFrame) -> DataFrame:
    """``seq_id, label, n, centroid, first_pos, last_pos``: what the store keeps of each topic beside its turns."""
    spans = scenes.groupBy("seq_id", "label").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    moments = topic_moments(scenes, "seq_id", "label").select("seq_id", "label", "n", F.col("mu").alias("centroid"))
    return join_small(moments, spans, ["seq_id", "label"])


def _top(rows: DataFrame, k: int, score: Column, tie: str, rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` best rows of each sequence; each block of positions yields at most ``k`` before they meet."""
    order = [score.desc(), F.col(tie)]
    inside = Window.partitionBy("seq_id", BLOCK).orderBy(*order)
    local = rows.withColumn(BLOCK, block_of(rows_per_block)).withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= k)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("seq_id").orderBy(*order))).where(F.col("rank") <= k).drop("_r", BLOCK)


def nearest_topics(scenes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` topics of each query's sequence whose centroids are most like ``query``; ties by label."""
    topics = topic_metadata(scenes)
    near = meet(topics, queries.select("seq_id", V.as_double("query").alias("query")), ["seq_id"])
    cos = V.cosine(F.col("centroid"), F.col("query"))
    scored = near.withColumn("cosine", cos).drop("query", "centroid")
    rank = F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("cosine"), "label"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def memory_window(scenes: DataFrame, queries: DataFrame, k: int, most_turns: int) -> DataFrame:
    """Turns of the ``k`` relevant topics in their order, the latest ``most_turns`` of each sequence."""
    topics = nearest_topics(scenes, queries, k).select("seq_id", "label")
    turns = meet(scenes.select("seq_id", "pos", "label"), topics, ["seq_id", "label"], "left_semi")
    return _top(turns, most_turns, F.col("pos"), "pos").select("seq_id", "pos", "label", (F.col("rank") - 1).alias("back"))


def sliding_window(scenes: DataFrame, most_turns: int) -> DataFrame:
    """The latest turns of each sequence, whatever their topic."""
    return _top(scenes.select("seq_id", "pos", "label"), most_turns, F.col("pos"), "pos").select("seq_id", "pos", "label", (F.col("rank") - 1).alias("back"))


def nearest_turns(scenes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Flat retrieval: the ``k`` turns of each query's sequence that are most like ``query``."""
    near = meet(scenes, queries.select("seq_id", V.as_double("query").alias("query")), ["seq_id"])
    scored = near.select("seq_id", "pos", "label", V.cosine(V.as_double("scene"), F.col("query")).alias("cosine"))
    return _top(scored, k, F.col("cosine"), "pos")


def topic_importance(
    scenes: DataFrame, size: float = 0.4, returns: float = 0.2, recency: float = 0.3, neighbours: float = 0.1
) -> DataFrame:
    """``importance`` of each topic: share of turns, share of returns, recency of the last turn and share of the
    other topics that it borders on. The weights are parameters, as the design leaves them open."""
    lagged = with_lag(scenes.select("seq_id", "pos", "label"), {"_prev": "label"})
    entered = (F.col("pos") > 0) & ~F.col("label").eqNullSafe(F.col("_prev"))
    per_topic = lagged.groupBy("seq_id", "label").agg(
        F.count("*").alias("n"), F.max("pos").alias("last_pos"), F.count_if(entered | (F.col("pos") == 0)).alias("visits")
    )
    moves = lagged.where(entered).select("seq_id", F.explode(F.array(
        F.struct(F.col("label").alias("label"), F.col("_prev").alias("other")), F.struct(F.col("_prev").alias("label"), F.col("label").alias("other"))
    )).alias("m")).select("seq_id", "m.*").distinct()
    borders = moves.groupBy("seq_id", "label").agg(F.count("*").alias("borders"))
    whole = per_topic.groupBy("seq_id").agg(
        F.sum("n").alias("turns"), F.sum(F.col("visits") - 1).alias("all_returns"), F.count("*").alias("topics"), F.max("last_pos").alias("end")
    )
    rows = join_small(join_small(per_topic, borders, ["seq_id", "label"]), whole, ["seq_id"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    score = (
        size * share(F.col("n"), F.col("turns")) + returns * share(F.col("visits") - 1, F.col("all_returns"))
        + recency * share(F.col("last_pos"), F.col("end")) + neighbours * share(F.coalesce("borders", F.lit(0)), F.col("topics") - 1)
    )
    return rows.select("seq_id", "label", "n", (F.col("visits") - 1).alias("returns"), "last_pos", F.coalesce("borders", F.lit(0)).alias("borders"), score.alias("importance"))


def topic_merges(topics: DataFrame, threshold: float, least_turns: int = 1) -> DataFrame:
    """``id, first``: topics (``id, n, centroid``) with the smallest id that they merge into.

    Two topics of ``least_turns`` turns or more link if the cosine of their centroids reaches ``threshold``; whatever is linked merges, over any number of steps. Equal
    centroids meet once. A topic that merges with none is its own ``first``.
    """
    usable = topics.where((F.col("n") >= least_turns) & F.col("centroid").isNotNull()).select("id", "centroid")
    same = usable.groupBy("centroid").agg(F.min("id").alias("first"))
    links = near_pairs(same.select(F.col("first").alias("id"), F.col("centroid").alias("vec")), 1.0 - threshold, "cosine", links=True).select("a", "b")
    copies = usable.join(same, "centroid").where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    merged = components(links.unionByName(copies))
    own = topics.select("id").where(F.col("id").isNotNull()).distinct()
    return own.join(merged, "id", "left").select("id", F.coalesce("first", "id").alias("first"))


def merged_topics(moments: DataFrame, merges: DataFrame) -> DataFrame:
    """``first, topics, n, mu, m2`` of the merged topics, from the ``id, n, mu, m2`` of the single ones."""
    parts = moments.join(merges, "id")
    sizes = parts.groupBy("first").agg(F.count("*").alias("topics"))
    return merge_moments(parts.select("first", "n", "mu", "m2"), "first").join(sizes, "first").select("first", "topics", "n", "mu", "m2")


def recognition(samples: DataFrame, *by: str, sharpness: float = 2.5) -> DataFrame:
    """Mean of ``exp(-2.5 d^2)`` to the true scene less the same to the lure (``mean, scene, lure``), over all samples."""
    like = lambda c: F.exp(F.lit(-sharpness) * V.squared_distance(F.col("mean"), F.col(c)))
    return samples.groupBy(*by).agg(F.count("*").alias("samples"), F.avg(like("scene") - like("lure")).alias("recognition"))


def edge_recall(rows: DataFrame) -> DataFrame:
    """Share of session edges at which a boundary is predicted (``session`` changes; ``is_boundary``), over all sequences."""
    lagged = with_lag(rows, {"_before": "session"})
    edge = (F.col("pos") > 0) & ~F.col("session").eqNullSafe(F.col("_before"))
    counts = lagged.agg(F.count_if(edge).alias("edges"), F.count_if(edge & F.col("is_boundary")).alias("found"))
    return counts.withColumn("recall", F.when(F.col("edges") > 0, F.col("found") / F.col("edges")))


def topics_per_session(rows: DataFrame) -> DataFrame:
    """``sessions`` and the mean number of topics in one."""
    topics = rows.groupBy("seq_id", "session", "label").agg(F.count("*").alias("_n"))
    per_session = topics.groupBy("seq_id", "session").agg(F.count("*").alias("topics"))
    return per_session.agg(F.count("*").alias("sessions"), F.avg("topics").alias("topics"))
