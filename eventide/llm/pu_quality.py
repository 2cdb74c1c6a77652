"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk.

Trusted positives are the documents marked good in the training fold. The unlabelled sample is all documents, whatever their
marks: it has to show the mixture of good and bad text as it is. With the class prior ``p`` and the logistic loss, the risk is
``p E+[l(z)] + max(0, E_u[l(-z)] - p E+[l(-z)])``: unlabelled text counts as bad, less the share of it that is good. The
clamp keeps the second part from going below zero; while it would, steps lower only that part, as the published rule has it.

The scorer is linear in statistics of the text's bytes and words, which one pass over the texts yields. Training covers all
documents: each Newton step is a job that sums loss, gradient and curvature per partition, and the driver adds up matrices
whose size depends only on the number of statistics. The class prior is the share of good marks in the training fold.

Inputs of a score are statistics of the text alone. Defined cases: a null or empty text has the statistics of no words and
gets a score like any other. Rows with a null id belong to the training fold and have no label. Of several labels of one id the highest counts.
Without positives all documents score the prior, and 1 if there are no labels at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import safe_join, table, written

ACCEPT = 0.7
STEPS = 16
#: Weight of the squared weights, and what is added to it per document's share, so that few documents fit fewer details.
RIDGE = 1e-4
RIDGE_ROWS = 5.0
#: Statistics of a text; the model also takes their squares.
N_STATS = 16
#: Bytes counted by kind: capitals, small letters, digits, blanks, line ends, stops, marks of exclamation, bars, other signs, non-ASCII.
_KINDS = np.full(256, 8)
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[[9, 11, 12, 13, 32]], _KINDS[10] = 0, 1, 2, 3, 4
_KINDS[[33, 63]], _KINDS[124], _KINDS[128:] = 6, 7, 9
_KINDS[[39, 44, 45, 46, 58, 59]] = 5
SCHEMA = "features array<float>"


def text_statistics(text: str) -> list[float]:
    """Statistics of a whole text, on scales of similar spread."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=10) if n else np.zeros(10)
    words = text.split()
    w = len(words)
    lines = text.split("\n")
    share = kinds / (n + 20.0)
    return [
        *np.log(share[[0, 2, 5, 6, 7, 8, 9]] * 100 + 0.1),
        np.log1p(w) / 2,
        (n - kinds[3] - kinds[4]) / (w + 1.0) / 4,
        len(set(words)) / (w + 5.0) * 3,
        (len(lines) - len(set(lines))) / (len(lines) + 2.0) * 3,
        np.log1p(w / len(lines)) / 2,
        (len(zlib.compress(raw, 1)) + 5.0) / (n + 40.0) * 4,
        sum(map(str.isalpha, words)) / (w + 2.0) * 3,
        sum(map(str.isupper, words)) / (w + 2.0) * 3,
        sum(map(str.istitle, words)) / (w + 2.0) * 3,
    ]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = np.array([text_statistics(t or "") for t in batch.column("text").to_pylist()], np.float32).reshape(-1, N_STATS)
        offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * N_STATS)
        column = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
        keep = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*keep, column], names=[c for c in batch.schema.names if c != "text"] + ["features"])


def expanded(features: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised statistics, their clipped squares, and a constant."""
    x = np.clip((features - centre) / spread, -8, 8)
    return np.hstack([x, np.minimum(x * x, 16) / 4, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS).astype(float)


def _totals(df: DataFrame, part) -> list[np.ndarray]:
    """Sum over all rows of what ``part`` makes of a batch; per partition one packed row reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch), batch.column("positive").to_numpy(zero_copy_only=False).astype(bool))
                sums = own if sums is None else [a + b for a, b in zip(sums, own)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[float(v) for s in sums for v in np.ravel(s)]], pa.list_(pa.float64())), pa.array([[len(np.ravel(s)) for s in sums]], pa.list_(pa.int64()))], names=["sums", "sizes"])

    rows = df.mapInArrow(run, "sums array<double>, sizes array<long>").collect()
    if not rows:
        return []
    return np.split(np.sum([r.sums for r in rows], axis=0), np.cumsum(rows[0].sizes)[:-1])


def _loss_parts(weights: np.ndarray, centre: np.ndarray, spread: np.ndarray):
    """Loss, gradient and curvature sums, apart for positives (both signs) and all text (as bad)."""

    def part(features: np.ndarray, positive: np.ndarray) -> list[np.ndarray]:
        x = expanded(features, centre, spread)
        z = x @ weights
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        good, as_bad = x[positive], np.logaddexp(0, z)
        bend = (p * (1 - p))[:, None] * x
        return [
            np.array([positive.sum(), len(x), np.logaddexp(0, -z[positive]).sum(), as_bad[positive].sum(), as_bad.sum()]),
            good.T @ (p[positive] - 1), good.T @ p[positive], x.T @ p, good.T @ bend[positive], x.T @ bend,
        ]

    return part


def fit(rows: DataFrame, prior: float, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Weights, centres and spreads from ``rows`` (``features``, ``positive``), or None without positives."""
    moments = _totals(rows, lambda x, good: [np.array([len(x), good.sum()]), x.sum(0), (x * x).sum(0)])
    if not moments or moments[0][1] == 0:
        return None
    centre = moments[1] / moments[0][0]
    spread = np.sqrt(np.maximum(moments[2] / moments[0][0] - centre**2, 0)) + 0.05
    d = 2 * N_STATS + 1
    ridge = (RIDGE + RIDGE_ROWS / moments[0][0]) * np.append(np.ones(d - 1), 1e-3)
    weights, best, least, shrink = np.zeros(d), np.zeros(d), np.inf, 1.0
    step = np.zeros(d)
    for _ in range(steps):
        sizes, up_good, down_good, down_all, bend_good, bend_all = _totals(rows, _loss_parts(weights, centre, spread))
        n_good, n_all = sizes[:2]
        rest = sizes[4] / n_all - prior * sizes[3] / n_good
        risk = prior * sizes[2] / n_good + max(0.0, rest) + (ridge * weights**2).sum() / 2
        if risk > least + 1e-9:
            shrink /= 2
            weights = best + shrink * step
            continue
        best, least, shrink = weights, risk, 1.0
        below = rest < 0
        rest_gradient = down_all / n_all - prior * down_good / n_good
        gradient = -rest_gradient if below else prior * up_good / n_good + rest_gradient + ridge * weights
        # Without the clamp the curvature of the positives cancels, since l(z) - l(-z) is linear.
        curvature = bend_all.reshape(d, d) / n_all + 0.02 * bend_good.reshape(d, d) / n_good + np.diag(ridge) + 1e-9 * np.eye(d)
        step = -np.linalg.solve(curvature, gradient)
        length = np.sqrt(step @ step)
        step *= min(1.0, 5.0 / max(length, 1e-12)) * (0.1 if below else 1.0)
        weights = best + step
        if length < 1e-3:
            break
    return best, centre, spread


def fold(key: Column, modulus: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % modulus


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's id, fold and score; ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``quality``."""
    plain = docs.select("doc_id", "text")
    features = plain.mapInArrow(_featurise, "doc_id long, features array<float>")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = features.select("doc_id", "features", held.alias("held_out"))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    usable = marks.where(fold(F.col("doc_id"), 4) != 2)
    rows = written(safe_join(rows, usable, ["doc_id"]).withColumn("positive", F.coalesce(F.col("quality") == 1, F.lit(False))), "pu-features")
    prior = usable.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    prior = 1.0 if prior is None else float(prior)
    # A negative mark is not used as such: the document is unlabelled text.
    model = fit(rows.select("features", "positive"), min(max(prior, 0.01), 0.99))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                values = np.full(batch.num_rows, prior)
            else:
                values = 1 / (1 + np.exp(-np.clip(expanded(_matrix(batch), *model[1:]) @ model[0], -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values)], names=["doc_id", "held_out", "score"])

    out = rows.select("doc_id", "held_out", "features").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Rows with one id stay if any of them is accepted."""
    kept = scored(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id").distinct()
    return safe_join(docs, kept, ["doc_id"], "left_semi")
