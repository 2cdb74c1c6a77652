"""Sticky Chinese-restaurant prior and the scores that go with it, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventide.functions import vector as V


def sticky_prior(counts: Column, prev: Column, alpha: float, lmda: float) -> Column:
    """Unnormalised prior over slots: counts, ``alpha`` at the first unused slot (if
    there is one), ``lmda`` on the previous slot (if there is one)."""
    slots = lambda used: F.transform(
        counts,
        lambda c, i: c.cast("double")
        + F.when(i == used, F.lit(float(alpha))).otherwise(F.lit(0.0))
        + F.when(prev.isNotNull() & (i == prev), F.lit(float(lmda))).otherwise(F.lit(0.0)),
    )
    return V.let(F.size(F.filter(counts, lambda c: c > 0)), slots)


def vmf_score(s: Column, mu: Column, kappa: float) -> Column:
    return V.cosine_to_centroid(s, mu) * float(kappa)


def anchor_score(s: Column, anchor: Column, sigma0_sq: float) -> Column:
    return V.cosine(s, anchor) * (1.0 / sigma0_sq)


def signal_score(cos: Column, jac: Column, ent: Column, b_cos, b_jac, b_ent) -> Column:
    return cos * float(b_cos) + jac * float(b_jac) + ent * float(b_ent)


def prior_scale(df: float, mode: float) -> float:
    """Scale of a scaled-inverse-chi-squared prior whose mode is ``mode``."""
    return mode * (df + 2.0) / df


def prior_mode(df: float, scale: float) -> float:
    return df / (df + 2.0) * scale
