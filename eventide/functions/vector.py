"""Vector maths over ``ARRAY<DOUBLE>`` columns, all JVM-side higher-order functions.

Scenes are stored as ``ARRAY<FLOAT>``; every builder here widens to DOUBLE first
so that sums do not depend on the storage type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

LOG_2PI = math.log(2.0 * math.pi)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is computed again for every element; binding it as a
    lambda variable avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; an all-zero vector stays as it is."""
    return let(
        v, lambda u: let(norm(u), lambda n: F.transform(u, lambda x: F.when(n > 0, x / n).otherwise(x)))
    )


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, c: Column | float) -> Column:
    return F.transform(v, lambda x: x * c)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """True cosine; 0 when either norm is below ``eps``."""
    safe = lambda na, nb: F.when((na < eps) | (nb < eps), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    return let(norm(a), lambda na: let(norm(b), lambda nb: safe(na, nb)))


def cosine_to_centroid(s: Column, mu: Column) -> Column:
    """Scene against an unnormalised centroid: divides by the centroid norm only."""
    return dot(s, mu) / (norm(mu) + 1e-9)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


#: Named metrics, so that callers choose one by a string.
METRICS = {
    "cosine": cosine_distance,
    "euclidean": euclidean,
    "dot": lambda a, b: -dot(a, b),
}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose one of {sorted(METRICS)}")
    return METRICS[metric](a, b)


def diagonal_loglik(s: Column, mu: Column, var: Column) -> Column:
    """Log density of a diagonal Gaussian."""
    quad = F.zip_with(subtract(s, mu), var, lambda e, v: e * e / v + F.log(v) + LOG_2PI)
    return total(quad) * -0.5


def zero_mean_loglik(e: Column, var: Column) -> Column:
    return total(F.zip_with(e, var, lambda x, v: x * x / v + F.log(v) + LOG_2PI)) * -0.5


def isotropic_loglik(s: Column, var: Column | float) -> Column:
    """Log density at the origin with one variance for all dimensions."""
    v = var if isinstance(var, Column) else F.lit(float(var))
    return (dot(s, s) / v + F.size(s) * (F.log(v) + LOG_2PI)) * -0.5


def prediction_error(s: Column, mu: Column, var: Column) -> Column:
    """Sum of squared errors in units of the variance."""
    return total(F.zip_with(subtract(s, mu), var, lambda e, v: e * e / v))


def array_logsumexp(v: Column) -> Column:
    shifted = lambda m: m + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    return let(F.array_max(v), shifted)


def array_softmax(v: Column) -> Column:
    return let(array_logsumexp(v), lambda z: F.transform(v, lambda x: F.exp(x - z)))


def first_argmax(v: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def fuse(prediction: Column, trace: Column, var: Column, tau: float) -> tuple[Column, Column]:
    """Precision-weighted mean and variance of a model prediction and a noisy trace."""
    weight = lambda v: (1.0 / v) / (1.0 / v + 1.0 / tau)
    mean = F.zip_with(
        F.zip_with(prediction, trace, lambda p, t: F.struct(p.alias("p"), t.alias("t"))),
        var,
        lambda pt, v: weight(v) * pt["p"] + (1.0 - weight(v)) * pt["t"],
    )
    return mean, F.transform(var, lambda v: 1.0 / (1.0 / v + 1.0 / tau))
