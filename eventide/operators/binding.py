"""Role/filler binding by circular convolution, and clean-up against a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from eventide.functions import hashed as H, vector as V
from eventide.operators import near
from eventide.operators.ordered import field_types, matrix
from eventide.session import bounded_rows


#: Rows of an Arrow batch that are worked on at a time; what is derived from a batch stays small beside it.
PART = 1024


def _in_parts(a: pd.Series, b: pd.Series, combine) -> pd.Series:
    rows = []
    for k in range(0, len(a), PART):
        rows.extend(combine(*(np.stack(c.iloc[k : k + PART].to_numpy()).astype(float) for c in (a, b))))
    return pd.Series(rows, dtype=object)


@F.pandas_udf(ArrayType(DoubleType()))
def bind(a: pd.Series, b: pd.Series) -> pd.Series:
    """Circular convolution of two vectors, many rows at a time."""
    return _in_parts(a, b, lambda x, y: np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), n=x.shape[1]))


@F.pandas_udf(ArrayType(DoubleType()))
def unbind(a: pd.Series, b: pd.Series) -> pd.Series:
    """Circular correlation divided by the dimension; binding has no such factor."""
    return _in_parts(a, b, lambda x, y: np.fft.irfft(np.fft.rfft(x) * np.conj(np.fft.rfft(y)), n=x.shape[1]) / x.shape[1])


def symbol_table(names: DataFrame, d: int, kind: str = "gaussian") -> DataFrame:
    """``name, vec`` for each distinct name; the vector is a function of the name only."""
    return names.select("name").distinct().select("name", H.symbol_vector(F.col("name"), d, kind).alias("vec"))


def superpose(vectors: DataFrame, vec: str, *by: str) -> DataFrame:
    """Sum of the vectors of a group, by dimension (partial sums before the shuffle)."""
    cells = vectors.select(*by, F.posexplode(vec).alias("dim", "x"))
    sums = cells.groupBy(*by, "dim").agg(F.sum("x").alias("x"))
    rows = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("c"))
    return rows.select(*by, F.col("c.x").alias(vec))


def encode_sentences(parts: DataFrame, fillers: DataFrame, roles: DataFrame, *by: str) -> DataFrame:
    """``<by>, vec``: the sum over a sentence of filler bound to role.

    ``parts`` has one row per (sentence, role, filler); both dictionaries are ``name, vec``
    and join by name, so the optimizer broadcasts them when they are small.
    """
    f = fillers.select(F.col("name").alias("filler"), F.col("vec").alias("_f"))
    r = roles.select(F.col("name").alias("role"), F.col("vec").alias("_r"))
    joined = parts.join(f, "filler").join(r, "role")
    return superpose(joined.select(*by, bind("_f", "_r").alias("vec")), "vec", *by)


#: Cells (symbols x dimensions) of a vocabulary that may be shipped to every task.
MAX_VOCABULARY_CELLS = 4_000_000


def _pair_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        scale = nx[:, None] * ny[None, :]
        safe = (nx[:, None] >= 1e-9) & (ny[None, :] >= 1e-9)
        return 1.0 - np.where(safe, x @ y.T / np.where(safe, scale, 1.0), 0.0)
    if metric == "euclidean":
        squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * x @ y.T
        return np.sqrt(np.maximum(squares, 0.0))
    raise ValueError(f"unknown metric {metric!r}")


#: Queries and symbols whose scores are held at a time: 8 million numbers.
TILE = (1024, 8192)


def _nearest(x: np.ndarray, table: np.ndarray, names: list[str], k: int, gamma: float, metric: str):
    """Per row the best ``k`` as (score, name), best first, plus maximum and scaled sum.

    Walks tiles of the score matrix with a running top k and softmax sum; ``names`` ascend, and on ties
    the first name wins.
    """
    best, peaks, masses = [], np.empty(len(x)), np.empty(len(x))
    for top in range(0, len(x), TILE[0]):
        rows = x[top : top + TILE[0]]
        n = len(rows)
        peak, mass = np.full(n, -np.inf), np.zeros(n)
        row, col, val = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for left in range(0, len(table), TILE[1]):
            score = -gamma * _pair_distances(rows, table[left : left + TILE[1]], metric)
            higher = np.maximum(peak, score.max(axis=1))
            mass = mass * np.exp(peak - higher) + np.exp(score - higher[:, None]).sum(axis=1)
            peak = higher
            if score.shape[1] > k:
                least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                r, c = np.nonzero(score >= least[:, None])
            else:
                r, c = np.nonzero(np.ones(score.shape, bool))
            row, col, val = np.append(row, r), np.append(col, c + left), np.append(val, score[r, c])
            order = np.lexsort((col, -val, row))
            row, col, val = row[order], col[order], val[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, val = row[place < k], col[place < k], val[place < k]
        ends = np.searchsorted(row, np.arange(n + 1))
        best += [
            [{"score": float(v), "name": names[j]} for v, j in zip(val[a:b], col[a:b])] for a, b in zip(ends[:-1], ends[1:])
        ]
        peaks[top : top + n], masses[top : top + n] = peak, mass
    return best, peaks, masses


_PARTIAL = "best array<struct<score:double,name:string>>, peak double, mass double"
_BEST_TYPE = pa.list_(pa.struct([("score", pa.float64()), ("name", pa.string())]))


def cleanup(
    queries: DataFrame, vocabulary: DataFrame, k: int, gamma: float = 50.0, metric: str = "cosine",
    vec: str = "vec", max_cells: int = MAX_VOCABULARY_CELLS, blocks: tuple[int, int] | None = None,
) -> DataFrame:
    """The ``k`` nearest symbols of each query with softmax probabilities over *all* symbols.

    Adds ``rank`` (from 1), ``name`` and ``prob``. ``vocabulary`` is ``name, vec``. A small
    vocabulary travels to the tasks as one matrix. A large one is cut into blocks: each
    (query block, vocabulary block) pair is a group of bounded size that yields its own top k
    and its part of the softmax sum, and those merge exactly; pairs are never emitted, and a task
    holds one tile of scores at a time. Queries count as different if a key or the vector
    differs; equal ones are looked up once and returned as often as they came, whatever the route.
    """
    keys = [c for c in queries.columns if c != vec]
    given = queries.groupBy(*keys, vec).agg(F.count("*").alias("_copies"))
    given = given.withColumn("_id", F.xxhash64(*keys, vec))
    inner = [*keys, "_copies", "_id"]
    fields = field_types(given, inner)
    if blocks is None:
        d = F.size("vec")
        size = vocabulary.agg(F.count("*").alias("n"), F.max(d).alias("d")).first()
        if (size["n"] or 0) * (size["d"] or 0) > max_cells:
            rows_per_block = max(1, max_cells // size["d"])
            blocks = (queries.count() // rows_per_block + 1, size["n"] // rows_per_block + 1)
    if blocks is None:
        rows = sorted(bounded_rows(vocabulary.select("name", "vec"), max_cells, "vocabulary"))
        names, table = [r["name"] for r in rows], np.array([r["vec"] for r in rows], dtype=float)

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in (whole.slice(at, PART) for whole in batches for at in range(0, whole.num_rows, PART)):
                best, peak, mass = _nearest(matrix(batch.column(vec)), table, names, k, gamma, metric)
                out = [batch.column(c) for c in inner]
                out += [pa.array(best, _BEST_TYPE), pa.array(peak), pa.array(mass)]
                yield pa.RecordBatch.from_arrays(out, names=inner + ["best", "peak", "mass"])

        merged = given.select(*inner, vec).mapInArrow(run, ", ".join(fields + [_PARTIAL]))
    else:
        merged = _merge_parts(_block_parts(given, vocabulary, inner, fields, k, gamma, metric, vec, blocks), inner, k)
    each = merged.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    ranked = each.select(*keys, "peak", "mass", F.posexplode("best").alias("_i", "_b"))
    prob = F.exp(F.col("_b.score") - F.col("peak")) / F.col("mass")
    return ranked.select(*keys, (F.col("_i") + 1).alias("rank"), F.col("_b.name").alias("name"), prob.alias("prob"))


def _block_parts(queries, vocabulary, keys, fields, k, gamma, metric, vec, blocks):
    """Partial results per (query, vocabulary block)."""
    nq, nv = blocks
    q = queries.withColumn("_q", F.pmod(F.col("_id"), F.lit(nq))).withColumn(
        "_v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nv - 1).cast("bigint")))
    )
    v = vocabulary.select("name", F.col("vec").alias("_vec")).withColumn(
        "_v", F.pmod(F.xxhash64("name"), F.lit(nv))
    ).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_schema = pa.schema(
            [left.schema.field(c) for c in keys]
            + [("best", _BEST_TYPE), ("peak", pa.float64()), ("mass", pa.float64())]
        )
        if not left.num_rows or not right.num_rows:
            return out_schema.empty_table()
        x = matrix(left.column(vec).combine_chunks())
        order = np.argsort(np.array(right.column("name").to_pylist()), kind="stable")
        names = [right.column("name")[int(i)].as_py() for i in order]
        table = matrix(right.column("_vec").combine_chunks())[order]
        best, peak, mass = _nearest(x, table, names, k, gamma, metric)
        columns = [left.column(c) for c in keys] + [pa.array(best, _BEST_TYPE), pa.array(peak), pa.array(mass)]
        return pa.Table.from_arrays(columns, schema=out_schema)

    return q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v")).applyInArrow(
        run, ", ".join(fields + [_PARTIAL])
    )


def _merge_parts(parts, keys, k):
    """Exact merge of block results: best of the bests, and softmax sums on one scale."""
    sums = parts.groupBy(*keys).agg(
        F.max("peak").alias("peak"),
        F.collect_list(F.struct("peak", "mass")).alias("_m"),
        F.flatten(F.collect_list("best")).alias("_best"),
    )
    order = lambda a, b: (
        F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
        .when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    )
    mass = F.aggregate("_m", F.lit(0.0), lambda acc, m: acc + m["mass"] * F.exp(m["peak"] - F.col("peak")))
    return sums.select(*keys, F.slice(F.array_sort("_best", order), 1, k).alias("best"), "peak", mass.alias("mass"))


def distance_matrix(vocabulary: DataFrame, metric: str = "cosine", within: float | None = None, tile: int = near.TILE) -> DataFrame:
    """``a, b, distance`` of the symbols (``name``, ``vec``) with ``a < b``: all pairs, or those at most ``within`` apart.

    Symbols meet tile by tile, whatever their number. Without ``within`` the result itself grows with the square of the dictionary; with it only cells that the
    triangle inequality leaves open meet, and the result holds near pairs alone. Names must differ.
    """
    everything = 2.0 if metric == "cosine" else float("inf")
    points = vocabulary.select(F.col("name").alias("id"), "vec")
    return near.near_pairs(points, everything if within is None else within, metric, tile=tile)
