import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from eventide.operators import metrics as M, responses as P, sweep as S, transitions as T


def prf(gt, pred):
    tp = sum(g and p for g, p in zip(gt, pred))
    fp = sum(p and not g for g, p in zip(gt, pred))
    fn = sum(g and not p for g, p in zip(gt, pred))
    p = tp / (tp + fp) if tp + fp else 0.0
    r = tp / (tp + fn) if tp + fn else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.booleans(), st.sampled_from([-0.2, 0.0, 0.1, 0.1 + 0.2, 0.3, 0.5, 0.9])), min_size=1, max_size=30),
    st.lists(st.sampled_from([-0.3, 0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 1.0]), min_size=1, max_size=7, unique=True),
)
def test_histogram_sweep_equals_the_naive_one(spark, rows, thetas):
    df = spark.createDataFrame(rows, "gt boolean, score double")
    got = {r["theta_id"]: r for r in S.threshold_sweep(df, thetas).collect()}
    assert len(got) == len(thetas)
    for i, t in enumerate(thetas):
        want = prf([g for g, _ in rows], [s < t for _, s in rows])
        assert (got[i]["precision"], got[i]["recall"], got[i]["f1"]) == pytest.approx(want)
        assert got[i]["theta"] == t
    best = S.first_best(S.threshold_sweep(df, thetas), "f1", "theta_id").first()
    top = max(r["f1"] for r in got.values())
    assert best["theta_id"] == min(i for i, r in got.items() if r["f1"] == top)


def test_long_threshold_lists_take_the_array_path(spark):
    df = spark.createDataFrame([(True, 0.05), (False, 0.5)], "gt boolean, score double")
    thetas = S.arange(0.0, 1.0, 0.01)
    rows = {r["theta_id"]: (r["tp"], r["fp"]) for r in S.threshold_sweep(df, thetas).collect()}
    assert rows == {i: (int(0.05 < t), int(0.5 < t)) for i, t in enumerate(thetas)}


def test_truth_drops_first_turns_and_handles_missing_labels(spark):
    df = spark.createDataFrame(
        [(1, 0, "a"), (1, 1, None), (1, 2, None), (1, 3, "b"), (2, 0, "b"), (2, 1, "b")],
        "seq_id int, pos int, label string",
    )
    got = sorted((r["seq_id"], r["pos"], r["gt"]) for r in T.label_shifts(df).collect())
    assert got == [(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)]
    flagged = {(r["seq_id"], r["pos"]): r["gt"] for r in T.flagged_shifts(df, "b").collect()}
    assert flagged == {(1, 1): False, (1, 2): False, (1, 3): True, (2, 1): True}


def test_all_boundary_threshold_and_first_turn(spark):
    tr = spark.createDataFrame([(1, 0, True, 0.1), (1, 1, True, 0.3), (1, 2, False, 0.2)],
                               "seq_id int, pos int, gt boolean, score double")
    assert M.f1_score(T.all_boundary(T.drop_first(tr))).first()["recall"] == 1.0
    pred = {r["pos"]: r["pred"] for r in T.below(tr, 0.3).collect()}
    assert pred == {0: True, 1: False, 2: True}


def test_zero_denominators(spark):
    df = spark.createDataFrame([(False, False)], "gt boolean, pred boolean")
    r = M.f1_score(df).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_adjusted_rand_closed_form(spark):
    rng = np.random.default_rng(0)
    t, p = rng.integers(0, 4, 60), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(t, p)], "t int, p int")
    c2 = lambda n: n * (n - 1) / 2
    both = sum(c2(np.sum((t == i) & (p == j))) for i in range(4) for j in range(3))
    a, b = sum(c2(np.sum(t == i)) for i in range(4)), sum(c2(np.sum(p == j)) for j in range(3))
    e = a * b / c2(60)
    assert M.adjusted_rand(df, "t", "p").first()["ari"] == pytest.approx((both - e) / ((a + b) / 2 - e))
    assert M.adjusted_rand(df, "t", "t").first()["ari"] == 1.0
    one = spark.createDataFrame([(1, 1), (1, 1)], "t int, p int")
    assert M.adjusted_rand(one, "t", "p").first()["ari"] == 1.0


def test_logsumexp_does_not_overflow(spark):
    df = spark.createDataFrame([(1, 1000.0), (1, 1001.0), (2, -1000.0)], "k int, x double")
    got = {r["k"]: r["logsumexp"] for r in M.logsumexp(df, "x", "k").collect()}
    assert got[1] == pytest.approx(1001 + math.log(1 + math.exp(-1))) and got[2] == pytest.approx(-1000)


def test_gates(spark):
    rows = [("a", "ours", 0.5), ("a", "base", 0.45), ("b", "ours", 0.5), ("b", "base", 0.6), ("c", "base", 0.1)]
    df = spark.createDataFrame(rows, "benchmark string, method string, f1 double")
    g = M.gate(df.withColumn("ms", F.lit(1.0)), "ours", "base", time="ms").cache()
    assert {r["benchmark"]: r["passed"] for r in g.collect()} == {"a": True, "b": False, "c": None}
    assert M.combined_gate(g, ["a", "b"]).first()["passed"] is False
    assert M.combined_gate(g, ["a", "missing"]).first()["passed"] is None
    assert M.combined_gate(g, ["b", "missing"]).first()["passed"] is False
    late = M.gate(df.withColumn("ms", F.lit(201.0)), "ours", "base", time="ms")
    assert {r["benchmark"]: r["passed"] for r in late.collect()}["a"] is False
    unknown = M.gate(df, "ours", "base")
    assert {r["benchmark"]: r["passed"] for r in unknown.collect()}["a"] is None


# --- time bins ---------------------------------------------------------------------

def count_presses(ms, seconds, width):
    """Presses per right-closed bin; those behind the last bin are lost."""
    ends = 1000.0 * width * (1 + np.arange(math.ceil(seconds / width)))
    place = np.searchsorted(ends, ms, side="left")
    return np.bincount(place[place < len(ends)], minlength=len(ends))


def expected_rpb(flags, values):
    one, zero = values[flags == 1], values[flags == 0]
    spread = np.sqrt(np.mean((values - values.mean()) ** 2))
    if not one.size or not zero.size or not spread:
        return None
    share = one.size / (one.size + zero.size)
    return (one.mean() - zero.mean()) / spread * math.sqrt(share * (1 - share))


@pytest.fixture(scope="module")
def presses(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), m, float(t)) for s in range(6) for m, n in (("A", 40), ("B", 15))
            for t in rng.integers(0, 26, size=n) * 500]
    return rows, spark.createDataFrame(rows, "subj int, movie string, ms double").cache()


def test_bins_rates_and_subjects(spark, presses):
    rows, df = presses
    seconds = {"A": 10.0, "B": 12.0}
    durations = spark.createDataFrame(list(seconds.items()), "movie string, seconds double")
    group, got = {}, {}
    for r in P.group_rate(df, durations, 1.0).collect():
        got[r["movie"], r["bin"]] = r["rate"]
    for m, sec in seconds.items():
        times = np.array(sorted({t for _, movie, t in rows if movie == m}))
        group[m] = count_presses(times, sec, 1.0) / 6
        assert [got[m, b] for b in range(int(sec))] == pytest.approx(list(group[m]))
    assert len(got) == 22
    values = np.concatenate([group["A"], group["B"]])
    for r in P.subject_point_biserial(df, durations, 1.0).collect():
        mine = np.concatenate([
            count_presses(np.array([t for s, movie, t in rows if s == r["subj"] and movie == m]), sec, 1.0)
            for m, sec in seconds.items()
        ])
        want = expected_rpb(mine, values)
        assert r["r_pb"] == (pytest.approx(want) if want is not None else None)


def test_permutations_move_flags_only(spark):
    rng = np.random.default_rng(2)
    rows = [("m", b, float(rng.random()), bool(rng.random() < 0.3)) for b in range(40)]
    df = spark.createDataFrame(rows, "movie string, bin int, value double, flag boolean")
    r0 = sorted((r["p"], r["r_pb"]) for r in P.permutation_null(df, 30, digits=1).collect())
    r1 = sorted((r["p"], r["r_pb"]) for r in P.permutation_null(df.repartition(7), 30, digits=3).collect())
    assert [p for p, _ in r0] == list(range(30)) and [x for _, x in r0] == pytest.approx([x for _, x in r1])
    assert abs(np.mean([x for _, x in r0])) < 0.15
    values = np.array(sorted((v for _, _, v, _ in rows), reverse=True))
    best = max(expected_rpb(np.arange(40) < m, values) for m in range(1, 31))
    rates = df.select("movie", "bin", F.col("value").alias("rate"))
    assert P.best_attainable(rates, 30).first()["r_pb"] == pytest.approx(best)


def test_boundary_bins(spark):
    flags = [i in (3, 7, 29) for i in range(30)]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "seq_id int, pos int, is_boundary boolean")
    # Frames 1..30 at ten per second: the last frame sits on the end of the last bin.
    want = [any(flags[i] for i in range(29) if (i + 1) // 10 == b) for b in range(3)]
    got = sorted((r["bin"], r["boundary"]) for r in P.binned_boundaries(df, 10.0, 1.0).collect())
    assert got == list(enumerate(want))


def test_regression_band(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=25)
    y = 2 * x + rng.normal(size=25)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    slope, icpt = np.polyfit(x, y, 1)
    fit = icpt + slope * x
    band = 2.07 * np.sqrt(np.sum((y - fit) ** 2) / 23 * (1 / 25 + (x - x.mean()) ** 2 / (np.sum(x**2) - 25 * x.mean() ** 2)))
    got = {r["x"]: r for r in P.regression_line(df, "x", "y", 2.07).collect()}
    for a, f, b in zip(x, fit, band):
        assert (got[float(a)]["fitted"], got[float(a)]["lower"]) == pytest.approx((f, f - b))
