"""Ordered streaming over sequences: the one place where order-dependent Python runs.

The rows of a sequence reach one task in order, as a stream of Arrow batches, and the state
carried from row to row has a size that does not depend on the length of the sequence. No
sequence is ever held in memory as a whole, and short sequences share batches, so there is
no per-group start-up cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from eventide.session import shuffle_partitions


def in_order(df: DataFrame, *order: str, salt: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Rows partitioned by sequence (and salt), sorted by the rest of the order.

    The number of partitions is explicit: the work per row is far larger than its bytes
    suggest, so byte-based coalescing would leave most cores idle.
    """
    keys = ["seq_id", *salt]
    n = partitions or shuffle_partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *(order or ("pos",)))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    n = len(column)
    if column.null_count:
        raise ValueError("a scene is null")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return values.reshape(0, 0)
    widths = np.diff(column.offsets.to_numpy())
    if (widths != widths[0]).any():
        raise ValueError("scenes differ in dimension")
    return values.reshape(n, int(widths[0]))


def stream(
    df: DataFrame, per_partition: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: StructType | str,
) -> DataFrame:
    return df.mapInArrow(per_partition, schema)


def field_types(df: DataFrame, names: list[str]) -> list[str]:
    """DDL fragments for columns passed through unchanged."""
    types = dict(df.dtypes)
    return [f"`{n}` {types[n]}" for n in names]
