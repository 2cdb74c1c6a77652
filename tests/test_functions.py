import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.functions import hashed as H, prior as P, text as X, vector as V
from eventide.operators import moments as M


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(values, kind="double"):
    return F.array(*[F.lit(v).cast(kind) for v in values])


@pytest.mark.parametrize(
    "counts, prev, alpha, lmda, expected",
    [
        ([0, 0, 0], None, 1.0, 10.0, [1, 0, 0]),
        ([3, 2, 0, 0, 0], 0, 1.0, 10.0, [13, 2, 1, 0, 0]),
        ([5, 3, 1, 0, 0], 1, 10.0, 1.0, [5, 4, 1, 10, 0]),
        ([5, 3, 2], None, 1.0, 10.0, [5, 3, 2]),
    ],
)
def test_sticky_prior(spark, counts, prev, alpha, lmda, expected):
    got = one(spark, P.sticky_prior(arr(counts, "int"), F.lit(prev).cast("int"), alpha, lmda))
    assert got == expected


@pytest.mark.parametrize("n, expected", [(0, 0.05), (1, 0.05), (2, 0.05), (3, 1e-6)])
def test_cold_start_and_floor(spark, n, expected):
    got = one(spark, M.topic_variance(F.lit(n), arr([0.0, 0.0]), 0.05))
    assert got == [expected, expected]


def test_likelihood_peaks_at_the_centroid(spark):
    mu, var = arr([0.1, -0.2, 0.3]), arr([0.5, 0.2, 0.1])
    near = one(spark, V.diagonal_loglik(mu, mu, var))
    far = one(spark, V.diagonal_loglik(arr([0.2, -0.2, 0.3]), mu, var))
    assert near > far
    assert one(spark, V.prediction_error(mu, mu, var)) == 0.0


def test_fusion_weights_by_precision(spark):
    mean, var = V.fuse(arr([0.0, 1.0]), arr([1.0, 0.0]), arr([0.5, 1.0]), 0.5)
    assert one(spark, mean) == pytest.approx([0.5, 1.0 / 3.0])
    assert one(spark, var) == pytest.approx([0.25, 1.0 / 3.0])


def test_prior_scale_and_mode():
    assert P.prior_scale(10.0, 0.05) == pytest.approx(0.06)
    assert P.prior_mode(10.0, 0.06) == pytest.approx(0.05)


STOPS = frozenset(X.STOP_WORDS)
NAME = "[A-Z][A-Za-z0-9]+"
RUN = re.compile(rf"(?<!\w){NAME}(?:\s+{NAME})*(?!\w)")


def expected_tokens(text):
    """Whole words made of ASCII letters only, judged one word at a time."""
    out = set()
    for word in re.split(r"\W+", text.lower()):
        if len(word) >= 3 and word.isascii() and word.isalpha():
            out.add(word)
    return out - STOPS


def expected_entities(text):
    """Runs of capitalised words behind the first space."""
    _, space, tail = text.strip().partition(" ")
    return {m.group().lower() for m in RUN.finditer(space + tail)} if space else set()


TEXTS = [
    "", "   ", "What is New York City like?", "Tell me about Marie Curie and  the Nobel Prize",
    "Élan Vital über Éa Straße Foo", "the THE cats_dogs cats-dogs x2 ab", "Who? Bar,Foo Bar.Foo BarÉ",
    "single", "a Foo_Bar Foo Bar Foo\nBar", "  Leading Spaces Here ", "He met Ann-Marie O'Neil in May 2020 A1 B",
    "ask Ärger Berlin Mitte",
]


@pytest.mark.parametrize("t", TEXTS)
def test_tokens_and_entities_follow_the_published_patterns(spark, t):
    t = unicodedata.normalize("NFC", t)
    assert set(one(spark, X.tokens(F.lit(t)))) == expected_tokens(t)
    assert set(one(spark, X.entities(F.lit(t)))) == expected_entities(t)


def test_tokens_and_entities_on_all_supplied_turns(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(
        "text", X.tokens("text").alias("t"), X.entities("text").alias("e")
    )
    for r in rows.collect():
        assert set(r["t"]) == expected_tokens(r["text"])
        assert set(r["e"]) == expected_entities(r["text"])


def test_jaccard_guards_the_empty_side(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, X.jaccard(empty, arr(["a"], "string"))) == 0.0
    assert one(spark, X.jaccard(arr(["a", "b"], "string"), arr(["b", "c"], "string"))) == pytest.approx(1 / 3)


def test_stored_context(spark):
    flat = arr(["q1", "a1", "q2", "a2", "odd"], "string")
    build = lambda k: one(spark, X.context_text(F.lit("now"), X.pair_up(flat), k))
    assert build(0) == "Q: now"
    assert build(1) == "Q: q2 A: a2 Q: now"
    assert build(5) == build("all") == "Q: q1 A: a1 Q: q2 A: a2 Q: now"
    assert one(spark, X.context_text(F.lit("now"), X.pair_up(F.array().cast("array<string>")), "all")) == "Q: now"


def test_draws_look_random_and_repeat(spark):
    keys = spark.range(4000).select(
        H.uniform(H.key("u", F.col("id"))).alias("u"), H.normal(H.key("n", F.col("id"))).alias("n"),
        H.integer(H.uniform(H.key("i", F.col("id"))), -2, 2).alias("i"),
    )
    rows = keys.collect()
    assert rows == keys.repartition(7).orderBy("u").collect() or sorted(rows) == sorted(keys.repartition(7).collect())
    u, n = np.array([r["u"] for r in rows]), np.array([r["n"] for r in rows])
    assert abs(u.mean() - 0.5) < 0.02 and 0 < u.min() and u.max() < 1
    assert abs(n.mean()) < 0.06 and abs(n.std() - 1) < 0.05
    assert {r["i"] for r in rows} == {-2, -1, 0, 1, 2}
