"""Linear scene dynamics per label, fitted in closed form."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventide.functions import vector as V
from eventide.operators.ordered import matrix
from eventide.operators.positions import BLOCK_ROWS, with_lag

#: Dimensions for which the (d+1) x (d+1) sums of a label fit one task.
MAX_DIM = 512
#: Labels a map task adds up at a time; it emits its sums and starts again beyond that.
OPEN_LABELS = 64


def linear_dynamics(scenes: DataFrame, ridge: float = 1e-3, rows: int = BLOCK_ROWS) -> DataFrame:
    """``label, dim, weights, bias, n`` of ``x_n = A x_{n-1} + b`` by ridge regression.

    A map task adds up the normal equations of its rows per label, the shuffle adds those
    sums by matrix row, and only (d+1) rows per label reach the solver, however many scenes
    there are. The bias is not penalised.
    """
    lagged = with_lag(
        scenes.select("seq_id", "pos", "label", "scene"), {"_x": "scene", "_l": "label"}, rows
    ).where((F.col("pos") > 0) & (F.col("label") == F.col("_l")))
    pairs = lagged.select("label", V.as_double("_x").alias("a"), V.as_double("scene").alias("b"))
    label_type = dict(pairs.dtypes)["label"]

    def emit(gram, label_arrow):
        rows = [(label, i, r.tolist()) for label, g in gram.items() for i, r in enumerate(g)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], label_arrow), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
            names=["label", "i", "row"],
        )

    def sums(batches):
        gram: dict = {}
        label_arrow = None
        for batch in batches:
            label_arrow = batch.schema.field("label").type
            if not batch.num_rows:
                continue
            a, b = matrix(batch.column("a")), matrix(batch.column("b"))
            if a.shape[1] > MAX_DIM:
                raise ValueError(f"more than {MAX_DIM} dimensions")
            labels = np.array(batch.column("label").to_pylist(), dtype=object)
            one = np.hstack([a, np.ones((len(a), 1))])
            for label in dict.fromkeys(labels.tolist()):
                m = labels == label
                part = one[m].T @ np.hstack([one[m], b[m]])
                gram[label] = gram[label] + part if label in gram else part
                if len(gram) >= OPEN_LABELS:
                    yield emit(gram, label_arrow)
                    gram = {}
        if gram:
            yield emit(gram, label_arrow)

    partial = pairs.mapInArrow(sums, f"label {label_type}, i int, row array<double>")
    cells = partial.select("label", "i", F.posexplode("row").alias("j", "v"))
    total = cells.groupBy("label", "i", "j").agg(F.sum("v").alias("v"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        table = np.zeros((n, int(pdf["j"].max()) + 1))
        table[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["v"].to_numpy()
        penalty = ridge * np.eye(n)
        penalty[-1, -1] = 0.0
        w = np.linalg.solve(table[:, :n] + penalty, table[:, n:])
        return pd.DataFrame(
            {
                "label": pdf["label"].iloc[0],
                "dim": np.arange(n - 1, dtype=np.int32),
                "weights": [c.tolist() for c in w[:-1].T],
                "bias": w[-1],
                "n": int(round(table[n - 1, n - 1])),
            }
        )

    return total.groupBy("label").applyInPandas(
        solve, f"label {label_type}, dim int, weights array<double>, bias double, n bigint"
    )
