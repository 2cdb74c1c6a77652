"""Cutting a sequence into blocks changes nothing: blocks of three rows against one block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import context as C, events as N, responses as P, running as R, transitions as T
from eventide.operators.positions import dense_positions, with_lag
from planted import frame, wandering


@pytest.fixture(scope="module")
def scenes(spark):
    rng = np.random.default_rng(11)
    # One sequence holds most of the rows.
    sequences = [wandering(rng, n, d=5, k=3) for n in (37, 1, 9, 3)]
    tokens = [[sorted({str(w) for w in rng.integers(0, 9, size=3)}) for _ in y] for _, y in sequences]
    return frame(spark, sequences, tokens=tokens).cache()


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-8, abs=1e-9)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def same(left, right):
    a = sorted((tuple(r) for r in left.collect()), key=lambda r: r[:2])
    b = sorted((tuple(r) for r in right.collect()), key=lambda r: r[:2])
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert close(x, y), (x, y)


def sets(df):
    return df.withColumn("known", F.array_sort("known")).select("seq_id", "pos", "known")


OPERATORS = {
    "lag": lambda s, n: with_lag(s.select("seq_id", "pos", "label"), {"p": "label"}, n),
    "shifts": lambda s, n: T.label_shifts(s, n),
    "cosine": lambda s, n: T.scored_transitions(s, "cosine", "scene", n),
    "unroll": lambda s, n: C.unroll(s.select("seq_id", "pos", "scene"), 3, n),
    "mean": lambda s, n: R.running_mean(s, n).select("seq_id", "pos", "mean"),
    "scores": lambda s, n: R.running_scores(s, 0.05, n),
    "boundary": lambda s, n: R.boundary_scores(s, 0.05, n),
    "counts": lambda s, n: R.running_counts(s.select("seq_id", "pos", "label"), n),
    "logprob": lambda s, n: R.label_logprob(s, 1.0, 5.0, n),
    "last": lambda s, n: R.previous_in_topic(s, n).select("seq_id", "pos", "last_scene"),
    "trailing": lambda s, n: R.trailing_variance(s, 3, rows=n).select("seq_id", "pos", "trailing_var"),
    "anchor": lambda s, n: R.moving_anchor(s, 0.3, rows=n),
    "tokens": lambda s, n: sets(R.accumulated_tokens(s, rows=n)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_blocks_are_exact(scenes, name):
    same(OPERATORS[name](scenes, 3), OPERATORS[name](scenes, 10_000))


@pytest.mark.parametrize("k", [0, 1, 2, "all"])
def test_context_blocks(spark, k):
    rows = [(s, i, f"q{s}.{i}", f"a{s}.{i}") for s, n in enumerate((11, 1, 4)) for i in range(n)]
    asked = spark.createDataFrame(rows, "seq_id int, pos int, text string, answer string")
    got = {(r["seq_id"], r["pos"]): r["context"] for r in C.contextualized(asked, k, 3).collect()}
    for s, i, q, _ in rows:
        start = 0 if k == "all" else max(0, i - k)
        earlier = [f"Q: q{s}.{j} A: a{s}.{j}" for j in range(start, i)]
        assert got[s, i] == " ".join(earlier + [f"Q: {q}"])


def test_questions_across_block_borders(spark):
    turns = spark.createDataFrame(
        [(1, i, r, t) for i, (r, t) in enumerate(
            [("system", "s"), ("user", "q0"), ("assistant", "a0"), ("user", "q1"), ("user", "q2"), ("assistant", "a2")])],
        "seq_id int, pos int, label string, text string",
    )
    for rows in (2, 3, 100):
        got = sorted((r["pos"], r["turn"], r["text"], r["answer"]) for r in C.questions(turns, rows=rows).collect())
        assert got == [(0, 1, "q0", "a0"), (1, 3, "q1", ""), (2, 4, "q2", "a2")]


def test_dense_positions_do_not_depend_on_the_bucket(spark):
    rows = [(i % 2, (i * 7) % 50, i) for i in range(50)]
    df = spark.createDataFrame(rows, "seq_id int, t int, id int")
    for bucket in (F.lit(0), F.floor(F.col("t") / 5), F.col("t")):
        got = {(r["seq_id"], r["id"]): r["pos"] for r in dense_positions(df, ["t", "id"], bucket).collect()}
        for s in (0, 1):
            order = sorted((t, i) for q, t, i in rows if q == s)
            assert [got[s, i] for _, i in order] == list(range(len(order)))


def test_surprise_and_boundary_probability_blocks(scenes):
    full = N.run_events(scenes, N.EventConfig(alfa=1.0, lmda=2.0), full=True).cache()
    same(N.event_surprise(full, 3), N.event_surprise(full, 10_000))
    joint = full.select(
        "seq_id", "pos", F.zip_with("log_like", "log_prior", lambda a, b: a + b).alias("log_post")
    )
    same(P.boundary_log_probability(joint, 3), P.boundary_log_probability(joint, 10_000))


def test_missing_labels_and_times_are_kept(spark):
    df = spark.createDataFrame(
        [(1, i, "a" if i % 3 else None) for i in range(10)], "seq_id int, pos int, label string"
    )
    for rows in (2, 100):
        got = {r["pos"]: r["c"] for r in R.running_counts(df, rows).collect()}
        assert got == {i: sum(1 for j in range(i) if bool(j % 3) == bool(i % 3)) for i in range(10)}
    timed = spark.createDataFrame([(1, None, 0), (1, 5, 1), (None, 1, 2), (None, None, 3)], "seq_id int, t int, id int")
    placed = dense_positions(timed, ["t", "id"], F.col("t")).collect()
    assert sorted((r["id"], r["pos"]) for r in placed) == [(0, 0), (1, 1), (2, 1), (3, 0)]


def test_moving_anchor_equals_a_loop(spark, scenes):
    """A null label is a label, and a kept column may be null."""
    rows = scenes.withColumn("label", F.when(F.col("label") > 0, F.col("label"))).withColumn("note", F.when(F.col("pos") > 2, F.col("pos")))
    anchors, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r["seq_id"], r["pos"])):
        key, x = (r["seq_id"], r["label"]), np.array(r["scene"])
        a = anchors.get(key)
        want[r["seq_id"], r["pos"]] = (r["label"], r["note"], None if a is None else float(a @ x / np.sqrt((a @ a) * (x @ x))))
        anchors[key] = x if a is None else 0.3 * x + 0.7 * a
    for n in (1, 4):
        got = {(r["seq_id"], r["pos"]): (r["label"], r["note"], r["anchor_cos"]) for r in R.moving_anchor(rows, 0.3, ("note",), n).collect()}
        assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want)
    assert R.moving_anchor(rows.limit(0), 0.3).count() == 0
