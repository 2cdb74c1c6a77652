"""Order-aware helpers that never put a whole sequence into one task.

One sequence may hold a large share of all rows. A window over ``seq_id`` alone would then
run in a single task, so the helpers here cut each sequence into blocks of consecutive
positions and make the blocks exact again:

* a *halo* repeats the last rows of a block in the next block, which is enough for ``lag``
  and for frames of bounded length;
* a *carry* summarises each block, takes a running total over the (few) block rows and
  joins it back, which is enough for frames that start at the beginning of the sequence.

Both need dense positions (0, 1, 2, ...), which :func:`dense_positions` produces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: Rows of one sequence that are handled together.
BLOCK_ROWS = 65_536
BLOCK = "_block"


def join_small(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Left equi-join in which NULL keys meet NULL keys, so that no row is lost."""
    renamed = side.select(
        *[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in side.columns]
    )
    condition = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return rows.join(renamed, condition, "left").drop(*[f"_key_{k}" for k in keys])


def meet(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Inner or left semi equi-join in which NULL keys meet NULL keys; the keys come from ``rows``."""
    renamed = side.select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in side.columns])
    joined = rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], how)
    return joined if how == "left_semi" else joined.drop(*[f"_key_{k}" for k in keys])


def block_of(rows: int = BLOCK_ROWS) -> Column:
    return F.call_function("div", F.col("pos"), F.lit(rows))


def dense_positions(df: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Add ``pos``, the rank of a row in its sequence by ``order``.

    ``bucket`` must be monotone in ``order`` (an hour of the time stamp, a leading sort key).
    Rows are ranked inside (sequence, bucket); the offsets come from counts per bucket.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy("seq_id", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("seq_id").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "seq_id", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("seq_id", "_bucket").orderBy(*order)
    ranked = join_small(rows, offsets, ["seq_id", "_bucket"]).withColumn(
        "pos", F.col("_offset") + F.row_number().over(inside) - 1
    )
    return ranked.drop("_bucket", "_offset")


def with_halo(
    df: DataFrame, before: int, rows: int = BLOCK_ROWS, after: int = 0
) -> tuple[DataFrame, Column]:
    """Rows with a block key; the last ``before`` rows of a block are repeated in the next
    one and the first ``after`` rows in the previous one.

    Also returns the predicate that keeps the original rows once the windows are done.
    """
    # A frame reaches at most one block on either side, so blocks are at least as long.
    rows = max(rows, before, after)
    own = block_of(rows)
    place = F.col("pos") % rows
    here = F.array(own)
    late = F.when(place >= rows - before, F.array(own + 1)) if before else None
    early = F.when((place < after) & (own > 0), F.array(own - 1)) if after else None
    blocks = [b for b in (here, late, early) if b is not None]
    none = F.array().cast("array<bigint>")
    return (
        df.withColumn(BLOCK, F.explode(F.concat(*[F.coalesce(b, none) for b in blocks]))),
        F.col(BLOCK) == own,
    )


def halo_window() -> WindowSpec:
    return Window.partitionBy("seq_id", BLOCK).orderBy("pos")


def with_lag(df: DataFrame, columns: dict[str, str], rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the previous row's value for each ``{new column: column}``; one shuffle."""
    haloed, own = with_halo(df, 1, rows)
    w = halo_window()
    lagged = haloed.select(
        "*", *[F.lag(source).over(w).alias(name) for name, source in columns.items()]
    )
    return lagged.where(own).drop(BLOCK)


def with_carry(
    df: DataFrame,
    keys: list[str],
    partials: dict[str, Column],
    carried: Callable[[WindowSpec, WindowSpec], dict[str, Column]],
    rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, WindowSpec]:
    """Join to every row what its key accumulated in earlier blocks.

    ``partials`` summarise one block (with partial aggregation before the shuffle), and
    ``carried(before, previous)`` combines them: ``before`` frames all earlier blocks of the
    key, ``previous`` orders the blocks for ``lag``. Returns the rows and the window
    (unframed, ordered by ``pos``) for the part inside a block.
    """
    rows_df = df.withColumn(BLOCK, block_of(rows))
    per_block = rows_df.groupBy(*keys, BLOCK).agg(*[c.alias(n) for n, c in partials.items()])
    ordered = Window.partitionBy(*keys).orderBy(BLOCK)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        *keys, BLOCK, *[c.alias(n) for n, c in carried(before, ordered).items()]
    )
    return (
        join_small(rows_df, carry, [*keys, BLOCK]),
        Window.partitionBy(*keys, BLOCK).orderBy("pos"),
    )
