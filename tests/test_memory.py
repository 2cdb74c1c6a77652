import math

import numpy as np
import pytest

from eventide.operators import binding as B, memory as Y
from eventide.operators.dynamics import linear_dynamics
from planted import frame, wandering


def circular(a, b):
    d = len(a)
    return [sum(a[i] * b[(k - i) % d] for i in range(d)) for k in range(d)]


def test_bind_and_unbind(spark):
    rng = np.random.default_rng(0)
    d = 256
    a, b = rng.normal(size=(2, d)) / math.sqrt(d)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    r = df.select(B.bind("a", "b").alias("bound")).select("bound").first()["bound"]
    assert r == pytest.approx(circular(a, b))
    back = df.select(B.unbind(B.bind("a", "b"), "b").alias("v")).first()["v"]
    assert np.corrcoef(back, a)[0, 1] > 0.6
    # Unbinding divides by the dimension; binding does not.
    c = np.real(np.fft.ifft(np.fft.fft(r) * np.conj(np.fft.fft(b)))) / d
    assert back == pytest.approx(c.tolist())


def test_sentences_decode_to_their_fillers(spark):
    words = ["ask", "answer", "tom", "jill", "dog", "cat"]
    d = 512
    names = lambda ws: spark.createDataFrame([(w,) for w in ws], "name string")
    fillers, roles = B.symbol_table(names(words), d), B.symbol_table(names(["Verb", "Agent", "Patient"]), d)
    parts = spark.createDataFrame(
        [(0, "Verb", "ask"), (0, "Agent", "tom"), (0, "Patient", "jill"), (1, "Verb", "answer"), (1, "Agent", "cat"), (1, "Patient", "tom")],
        "s int, role string, filler string",
    )
    vecs = B.encode_sentences(parts, fillers, roles, "s")
    asked = parts.select("s", "role").join(vecs, "s").join(roles.withColumnRenamed("name", "role").withColumnRenamed("vec", "r"), "role")
    decoded = asked.select("s", "role", B.unbind("vec", "r").alias("vec"))
    top = {(r["s"], r["role"]): (r["name"], r["prob"]) for r in B.cleanup(decoded, fillers, 1).collect()}
    want = {(s, role): filler for s, role, filler in (tuple(r) for r in parts.collect())}
    assert {k: v[0] for k, v in top.items()} == want
    assert all(p > 0.5 for _, p in top.values())


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_cleanup_in_blocks_is_exact(spark, metric):
    rng = np.random.default_rng(1)
    vocab = spark.createDataFrame([(f"w{i:02d}", rng.normal(size=8).tolist()) for i in range(23)], "name string, vec array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(11)], "q int, vec array<double>")
    key = lambda df: sorted((r["q"], r["rank"], r["name"], round(r["prob"], 9)) for r in df.collect())
    direct = key(B.cleanup(queries, vocab, 3, gamma=5.0, metric=metric))
    assert len(direct) == 33
    for blocks in ((1, 1), (2, 5), (4, 30)):
        assert key(B.cleanup(queries, vocab, 3, gamma=5.0, metric=metric, blocks=blocks)) == direct
    # The size check chooses the blocks by itself.
    assert key(B.cleanup(queries, vocab, 3, gamma=5.0, metric=metric, max_cells=40)) == direct


@pytest.mark.parametrize("metric,within", [("cosine", None), ("euclidean", None), ("euclidean", 2.0), ("cosine", 0.4)])
def test_distance_matrix_tile_by_tile(spark, metric, within):
    rng = np.random.default_rng(4)
    vectors = [*rng.normal(size=(40, 5)), *(np.ones(5) + 0.01 * rng.normal(size=(60, 5))), np.zeros(5)]
    vocab = spark.createDataFrame([(f"w{i:03d}", v.tolist()) for i, v in enumerate(vectors)], "name string, vec array<double>")
    full = B._pair_distances(np.array(vectors), np.array(vectors), metric)
    expected = {(f"w{i:03d}", f"w{j:03d}"): full[i, j] for i in range(101) for j in range(i + 1, 101) if within is None or full[i, j] <= within}
    got = B.distance_matrix(vocab, metric, within, tile=16).collect()
    assert len(got) == len(expected)
    assert all(abs(expected[r.a, r.b] - r.distance) < 1e-6 for r in got)


@pytest.fixture(scope="module")
def scenes(spark):
    rng = np.random.default_rng(6)
    sequences = [wandering(rng, n, d=4, k=3) for n in (14, 5)]
    return sequences, frame(spark, sequences).cache()


def test_corruption_is_a_function_of_the_key(scenes):
    _, df = scenes
    key = lambda rows: [(a, b, e if e is not None else -1, t, x) for a, b, e, t, x in rows]
    one = sorted(key((r["seq_id"], r["trace_id"], r["e"], r["t"], tuple(r["x"])) for r in Y.corrupt(df, 0.01, 0.5, 2).collect()))
    two = sorted(key((r["seq_id"], r["trace_id"], r["e"], r["t"], tuple(r["x"])) for r in Y.corrupt(df.repartition(9), 0.01, 0.5, 2).collect()))
    assert one == two and all(abs(t - p) <= 2 for _, p, _, t, _ in one)
    other = Y.corrupt(df, 0.01, 0.5, 2, seed="1").collect()
    assert {tuple(r["x"]) for r in other} != {x for *_, x in one}


def test_trace_posterior_against_loops(spark, scenes):
    sequences, df = scenes
    traces = Y.corrupt(df, 0.05, 0.6, 1).cache()
    got = {(r["seq_id"], r["pos"], r["trace_id"]): r["log_p"] for r in Y.trace_posterior(traces, df, 1, 0.05, 1e-3).collect()}
    held = traces.collect()
    seen = 0
    for s, (x, y) in enumerate(sequences):
        for n in range(len(x)):
            scores = {None: math.log(1e-3)}
            for t in held:
                if t["seq_id"] == s and abs(t["t"] - n) <= 1 and t["e"] in (None, y[n]):
                    e = np.array(t["x"]) - x[n]
                    scores[t["trace_id"]] = -0.5 * float(np.sum(e * e / 0.05 + math.log(2 * math.pi * 0.05)))
            m = max(scores.values())
            z = m + math.log(sum(math.exp(v - m) for v in scores.values()))
            for t, v in scores.items():
                assert got[s, n, t] == pytest.approx(v - z)
                seen += 1
    assert seen == len(got)
    draws = Y.draw_traces(Y.trace_posterior(traces, df, 1, 0.05, 1e-3), 4)
    rows = draws.collect()
    assert len(rows) == 4 * sum(len(x) for x, _ in sequences)
    assert all((r["seq_id"], r["pos"], r["trace_id"]) in got for r in rows)


def test_recall_counts_samples_once_and_skips_null_slots(spark):
    traces = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0])], "seq_id int, trace_id int, x array<double>")
    samples = spark.createDataFrame(
        [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, None), (2, 1, [1.0, 2.0]), (2, 2, [3.0, 4.0])],
        "sample_id int, seq_id int, x array<double>",
    )
    got = {r["trace_id"]: r["recall"] for r in Y.recall(samples, traces, 4).collect()}
    assert got == {0: 0.5, 1: 0.0}


def test_fusion_keeps_the_model_for_empty_slots(spark):
    rows = [(1, [0.0], [1.0], [2.0]), (2, [0.5], [1.0], None)]
    df = spark.createDataFrame(rows, "pos int, mu array<double>, var array<double>, x array<double>")
    got = {r["pos"]: (r["mean"], r["variance"]) for r in Y.fuse_traces(df, 1.0).collect()}
    assert got == {1: ([1.0], [0.5]), 2: ([0.5], [1.0])}


def test_linear_dynamics_equal_ridge_regression(spark):
    rng = np.random.default_rng(9)
    turn = np.array([[0.0, 1, 0], [-1, 0, 0], [0, 0, 0.5]])
    sequences = []
    for label in (0, 1, 0, 1):
        x = [rng.normal(size=3)]
        for _ in range(40):
            x.append((turn if label else 0.9 * np.eye(3)) @ x[-1] + rng.normal(scale=0.3, size=3))
        sequences.append((np.array(x), [label] * 41))
    rows = linear_dynamics(frame(spark, sequences), ridge=0.5, rows=7).collect()
    assert len(rows) == 6 and {r["n"] for r in rows} == {80}
    for r in rows:
        mine = [x for x, y in sequences if y[0] == r["label"]]
        a = np.hstack([np.concatenate([x[:-1] for x in mine]), np.ones((80, 1))])
        b = np.concatenate([x[1:] for x in mine])
        w = np.linalg.solve(a.T @ a + 0.5 * np.diag([1, 1, 1, 0]), a.T @ b)
        assert r["weights"] == pytest.approx(w[:3, r["dim"]].tolist())
        assert r["bias"] == pytest.approx(w[3, r["dim"]])


def test_a_batch_is_bound_in_parts(monkeypatch):
    """However many rows a batch has, few are transformed at a time."""
    import pandas as pd

    rng, seen, whole = np.random.default_rng(3), [], np.fft.rfft
    a, b = rng.normal(size=(2, 5000, 8))
    monkeypatch.setattr(np.fft, "rfft", lambda x: seen.append(len(x)) or whole(x))
    got = np.stack(B.bind.func(pd.Series(list(a)), pd.Series(list(b))))
    back = np.stack(B.unbind.func(pd.Series(list(a)), pd.Series(list(b))))
    assert max(seen) <= 1024
    assert (got == np.fft.irfft(whole(a) * whole(b), n=8)).all() and (back == np.fft.irfft(whole(a) * np.conj(whole(b)), n=8) / 8).all()
    assert not len(B.bind.func(pd.Series([], dtype=object), pd.Series([], dtype=object)))
