"""Pairs of points within a distance, exactly and without meeting all pairs; connected components of links.

Points are dealt to the cell of their nearest pivot, a point of a bounded sample. If two points lie within ``r``, the triangle
inequality says that the second one's distance to the pivot of the first exceeds that to its own pivot by at most ``2 r``. So each point also *visits* the cells whose pivots are
that close, and every near pair meets in the cell of one of both. A visitor goes only to cells before its own, so that a pair meets once.

A cell may hold a third of all points. Its points are cut into tiles of bounded size by a hash, and tiles meet two by two in tasks of their own. What a task holds is two tiles, whatever the cell holds.

``links=True`` gives, instead of all pairs of a meeting, links that connect the same points: at most one for each point in a meeting, where a group of ``n`` copies has ``n * n / 2`` pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from eventide.functions import vector as V
from eventide.operators.ordered import matrix
from eventide.session import ensure_checkpoint_dir

#: Pivots, and points of a tile.
PIVOTS = 256
TILE = 1024
#: Distances are rounded: pairs this much farther apart still meet and are then judged by the exact rule.
SLACK = 1e-9
METRICS = ("euclidean", "cosine")


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(norms >= 1e-9, x / np.where(norms > 0, norms, 1.0), 0.0)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, about the mean of ``y`` so that a common offset costs no digits."""
    centre = y.mean(axis=0)
    x, y = x - centre, y - centre
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * x @ y.T
    return np.sqrt(np.maximum(squares, 0.0))


def _dealer(pivots: np.ndarray, reach: float, unit: bool):
    """Cells of each point: its own first, then those before it that it visits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                x = matrix(part.column("vec"))
                d = _distances(_unit(x) if unit else x, pivots)
                own = d.argmin(axis=1)
                near = d <= d[np.arange(len(d)), own][:, None] + 2.0 * reach
                near &= np.arange(len(pivots))[None, :] <= own[:, None]
                row, cell = np.nonzero(near)
                columns = [part.column(c).take(pa.array(row)) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), pa.array(cell == own[row])], names=[*part.schema.names, "cell", "own"])

    return deal


def _first_of_group(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of ``n`` numbers over the links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meeter(metric: str, limit: float, reach: float, links: bool):
    """Near pairs of two tiles; ``a`` is the smaller id."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("id").type if left.num_rows else right.schema.field("id").type
        schema = pa.schema([("a", kind), ("b", kind), ("distance", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, others = left.column("id").combine_chunks(), right.column("id").combine_chunks()
        x, y = matrix(left.column("vec").combine_chunks()), matrix(right.column("vec").combine_chunks())
        if metric == "cosine":
            x, y = _unit(x), _unit(y)
        # Ids are compared by their place in a common order; points of one tile meet each other once.
        order = {v: k for k, v in enumerate(sorted(set(ids.to_pylist()) | set(others.to_pylist())))}
        left_at, right_at = (np.array([order[v] for v in c.to_pylist()]) for c in (ids, others))
        once = left.column("tile")[0].as_py() != right.column("tile")[0].as_py() or not right.column("own")[0].as_py()
        found = []
        for first in range(0, len(y), TILE):
            d = _distances(x, y[first : first + TILE])
            i, j = np.nonzero(d <= reach)
            j += first
            keep = (left_at[i] != right_at[j]) if once else (left_at[i] < right_at[j])
            i, j = i[keep], j[keep]
            exact = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1)) if metric == "euclidean" else 1.0 - (x[i] * y[j]).sum(axis=1)
            near = exact <= limit
            found.append((i[near], j[near], exact[near]))
        i, j, exact = (np.concatenate([f[k] for f in found]) for k in range(3))
        if links and len(i):
            # One link per point of a group, to the group's first point.
            names = np.array(sorted(order, key=order.get), dtype=object)
            group = _first_of_group(len(order), left_at[i], right_at[j])
            some = np.flatnonzero(group != np.arange(len(order)))
            return pa.table([pa.array(names[group[some]].tolist(), kind), pa.array(names[some].tolist(), kind), pa.nulls(len(some), pa.float64())], schema=schema)
        swap = left_at[i] > right_at[j]
        mine, theirs = ids.take(pa.array(i)), others.take(pa.array(j))
        a = pc.if_else(pa.array(swap), theirs, mine)
        b = pc.if_else(pa.array(swap), mine, theirs)
        return pa.table([a, b, pa.array(exact)], schema=schema)

    return meet


def near_pairs(points: DataFrame, limit: float, metric: str = "euclidean", links: bool = False, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """``a, b, distance`` of all pairs of ``points`` (``id``, ``vec``) within ``limit``, with ``a < b``.

    Ids must differ and not be NULL; a NULL vector has no pairs. ``metric`` is ``euclidean`` or ``cosine`` (1 less the cosine of the angle; a vector shorter than 1e-9 has cosine 0 to all).
    With ``links`` the distance is NULL and the pairs are links that connect what the near pairs connect.
    """
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    known = points.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select("id", V.as_double("vec").alias("vec"))
    kind = dict(known.dtypes)["id"]
    sample = known.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vec").collect()
    if not sample:
        return points.sparkSession.createDataFrame([], f"a {kind}, b {kind}, distance double")
    centre = np.array([r["vec"] for r in sample], dtype=float)
    unit = metric == "cosine"
    # The distance of unit vectors follows from their cosine; a zero vector is one apart from all of them.
    reach = (float(np.sqrt(max(2.0 * limit, 0.0))) if limit < 1 or not unit else 2.0) if unit else float(limit)
    reach = reach * (1 + SLACK) + SLACK * (1.0 if unit else float(np.abs(centre).max()) + 1.0)
    dealt = known.mapInArrow(_dealer(_unit(centre) if unit else centre, reach, unit), f"id {kind}, vec array<double>, cell int, own boolean")
    ensure_checkpoint_dir(points.sparkSession)
    dealt = dealt.checkpoint()
    sizes = dealt.where("own").groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    placed = dealt.join(sizes, "cell").withColumn("tile", F.when(F.col("own"), F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).otherwise(F.lit(-1)))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    left = placed.where("own").withColumn("at", F.explode(F.array_append(F.filter(every, lambda t: t >= F.col("tile")), F.lit(-1))))
    # Visitors meet every tile of the cell, in groups of about the size of a tile.
    visits = placed.where(~F.col("own")).withColumn("mine", F.explode(every)).withColumn("at", F.lit(-1))
    right = placed.where("own").withColumn("mine", F.explode(F.filter(every, lambda t: t <= F.col("tile")))).withColumn("at", F.col("tile")).unionByName(visits)
    columns = ["id", "vec", "tile", "own", "cell", "at"]
    left = left.select(*columns, F.col("tile").alias("mine"))
    crowd = visits.groupBy("cell", "mine").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("crowds"))
    # A tile meets as many groups of visitors as there are; a group of own points is one.
    meets = lambda df: df.join(crowd, ["cell", "mine"], "left").withColumn("crowds", F.when(F.col("at") == -1, F.col("crowds")).otherwise(1))
    left = meets(left).where("crowds IS NOT NULL").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
    right = meets(right.select(*columns, "mine")).withColumn("crowd", F.when(F.col("at") == -1, F.pmod(F.xxhash64("id", F.lit(7)), F.col("crowds")).cast("int")).otherwise(0))
    # Both sides come from one table; new names keep them apart.
    right = right.toDF(*right.columns)
    keys = ["cell", "mine", "at", "crowd"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meeter(metric, limit, reach, links), f"a {kind}, b {kind}, distance double")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, first``: the smallest id that each linked id reaches (``a``, ``b``), itself included.

    Each round every id points its larger neighbours, then its smaller ones, to the smallest of them (large star, small star), until all links point to a smallest
    id. Rounds are checkpointed; their number grows with the logarithm of the longest chain.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()

    def stars(edges: DataFrame, both: bool) -> DataFrame:
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = ends.join(least, "u")
        if both:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    mark = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    before = mark(edges)
    for _ in range(rounds):
        edges = stars(stars(edges, True), False).checkpoint()
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("first")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("first")).distinct())
        before = after
    raise RuntimeError(f"components are not settled after {rounds} rounds")
