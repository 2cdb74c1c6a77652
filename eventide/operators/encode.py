"""Text to unit vectors: the default hashed encoder, and a hook for a user's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventide.functions import text as X, vector as V


def hash_bucket(token: Column, d: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % d).cast("int")


def hashed_encoder(text: Column | str, d: int = 64) -> Column:
    """Unit vector of token counts in ``d`` hash buckets; zeros if there is no token."""
    buckets = F.transform(X.tokens(text), lambda t: hash_bucket(t, d))
    dims = F.sequence(F.lit(0), F.lit(d - 1))
    counts = V.let(
        buckets,
        lambda held: F.transform(dims, lambda i: F.size(F.filter(held, lambda b: b == i)).cast("double")),
    )
    return V.l2_normalize(counts)


def encode(
    turns: DataFrame, text: str = "text", out: str = "scene", d: int = 64,
    model: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
) -> DataFrame:
    """Adds the vector of each text.

    ``model`` is called once per Python worker and returns ``list of strings -> matrix``;
    its rows are L2-normalised here. Without a model the hashed encoder runs in the JVM.
    """
    if model is None:
        return turns.withColumn(out, hashed_encoder(F.col(text), d))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = model()
        for batch in batches:
            rows = np.asarray(embed(batch.fillna("").tolist()), dtype=np.float64)
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list(rows / np.where(norms > 0, norms, 1.0)))

    return turns.withColumn(out, run(F.col(text)))
