"""Deterministic pseudo-random draws.

``rand()`` depends on partitioning and on task retries; here every draw is a pure function
of a text key, so a lost executor, a retry or another partition count gives the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPAN = float(2**32)


def _word(key: Column, i: int) -> Column:
    return F.conv(F.substring(F.md5(key), 8 * i + 1, 8), 16, 10).cast("double")


def uniform(key: Column, i: int = 0) -> Column:
    """Uniform on (0, 1); ``i`` in 0..3 picks one of four independent words of the hash."""
    return (_word(key, i) + 0.5) / _SPAN


def normal(key: Column) -> Column:
    """Standard normal by the Box-Muller transform."""
    return F.sqrt(F.log(uniform(key, 0)) * -2.0) * F.cos(uniform(key, 1) * 6.283185307179586)


def gumbel(key: Column) -> Column:
    return -F.log(-F.log(uniform(key, 0)))


def key(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def integer(draw: Column, low: int, high: int) -> Column:
    """Uniform integer in ``low..high``, both ends included."""
    return (F.floor(draw * float(high - low + 1)) + low).cast("int")


def symbol_vector(name: Column, d: int, kind: str = "gaussian", spike: float = 1.0) -> Column:
    """Vector for a symbol: ``gaussian`` (variance 1/d), ``spike_slab`` or ``one_hot``."""
    dims = F.sequence(F.lit(0), F.lit(d - 1))
    if kind == "gaussian":
        return F.transform(dims, lambda i: normal(key(name, i)) / float(d) ** 0.5)
    if kind == "spike_slab":
        return F.transform(
            dims,
            lambda i: F.when(uniform(key(name, i), 2) < spike, normal(key(name, i))).otherwise(
                F.lit(0.0)
            ),
        )
    if kind == "one_hot":
        hot = integer(uniform(key(name, "hot")), 0, d - 1)
        return F.transform(dims, lambda i: (i == hot).cast("double"))
    raise ValueError(f"unknown kind {kind!r}")
