import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from eventide.operators import metrics
from eventide.operators import segment as G
from planted import blocks, frame, wandering
from plain_rules import assign_all

CASES = [
    G.Config(alpha=a, lmda=l, sigma0_sq=s0, scorer=sc, kappa=3 / s0**0.5, beta=0.3, k_max=k,
             new_score=2.0 if sc == "signals" else 0.6, b_cos=1.5, b_jac=3.0, b_ent=2.0)
    for sc in G.GAUSS + G.VMF + G.ANCHORS + G.SIGNALS
    for a, l, s0, k in ((1.0, 10.0, 0.01, 256), (10.0, 1.0, 0.1, 256), (0.5, 2.0, 0.05, 5))
]


def word_sets(rng, sequences, n, most):
    return [
        [sorted({str(w) for w in rng.integers(0, n, size=rng.integers(0, most))}) for _ in y]
        for _, y in sequences
    ]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    sequences = [wandering(rng, n) for n in (1, 5, 40, 17, 60, 3)]
    return sequences, word_sets(rng, sequences, 12, 5), word_sets(rng, sequences, 6, 3)


def expected(data, config):
    sequences, tokens, entities = data
    out = {}
    for s, (x, _) in enumerate(sequences):
        got = assign_all(x, config, [set(t) for t in tokens[s]], [set(e) for e in entities[s]])
        out |= {(s, i): r for i, r in enumerate(got)}
    return out


def assigned(df):
    return {(r["seq_id"], r["pos"]): (r["topic"], r["is_boundary"]) for r in df.collect()}


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_every_scorer_follows_the_rules_for_any_batch_size(data, size):
    sequences, tokens, entities = data
    keys = [s for s, (x, _) in enumerate(sequences) for _ in x]
    x = np.concatenate([x for x, _ in sequences])
    tok = [frozenset(t) for seq in tokens for t in seq]
    ent = [frozenset(e) for seq in entities for e in seq]
    runner = G.BatchRunner(CASES)
    parts = [
        runner.run(keys[i:i + size], x[i:i + size], tok[i:i + size], ent[i:i + size])
        for i in range(0, len(keys), size)
    ]
    topics = np.concatenate([p[0] for p in parts])
    changed = np.concatenate([p[1] for p in parts])
    for j, config in enumerate(CASES):
        want = list(expected(data, config).values())
        assert list(zip(topics[:, j].tolist(), changed[:, j].tolist())) == want, config


def test_chunks_of_sequences_do_not_matter(data, monkeypatch):
    monkeypatch.setattr(G.BatchRunner, "MAX_CELLS", 1)
    test_every_scorer_follows_the_rules_for_any_batch_size(data, 1000)


@pytest.mark.parametrize("config", [CASES[0], CASES[7], CASES[-1]], ids=lambda c: c.scorer)
def test_operator_equals_the_rules_and_ignores_partitioning(spark, data, config):
    sequences, tokens, entities = data
    want = expected(data, config)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        for partitions in (1, 5):
            df = frame(spark, sequences, partitions, tokens=tokens, entities=entities)
            assert assigned(G.segment(df, config, partitions=partitions)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_grid_equals_single_runs_and_any_number_of_copies(spark, data):
    sequences, tokens, entities = data
    df = frame(spark, sequences, tokens=tokens, entities=entities).cache()
    single = {}
    for i, c in enumerate(CASES[::5]):
        row = metrics.f1_score(G.with_truth(G.segment(df, c, keep=["label"]))).first()
        single[i] = (row["tp"], row["fp"], row["fn"])
    for per_copy in (2, 128):
        grid = G.grid_counts(df, CASES[::5], per_copy=per_copy)
        assert {r["cfg_id"]: (r["tp"], r["fp"], r["fn"]) for r in grid.collect()} == single
    grouped = G.grid_counts(df.withColumn("g", df["seq_id"] % 2), CASES[:2], by=("g",))
    pooled = {r["cfg_id"]: r["tp"] for r in G.grid_counts(df, CASES[:2]).collect()}
    assert {
        c: sum(r["tp"] for r in grouped.collect() if r["cfg_id"] == c) for c in (0, 1)
    } == pooled


def test_first_turn_and_boundary_flags(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([np.eye(8)[[0, 0, 0, 1, 1, 1]]]) + rng.normal(scale=0.01, size=(6, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = assigned(G.segment(frame(spark, [(x, [0] * 6)])))
    assert [got[0, i][1] for i in range(6)] == [False, False, False, True, False, False]
    assert got[0, 0][0] == 0


def test_planted_clusters_are_recovered(spark):
    rng = np.random.default_rng(7)
    sequences = [blocks(rng, [8, 8, 8], [0, 1, 2], d=32, k=3) for _ in range(6)]
    df = frame(spark, sequences).cache()
    out = G.segment(df, G.Config(sigma0_sq=0.01), keep=["label"])
    assert metrics.purity(out, "label", "topic", "seq_id").agg({"min_purity": "min"}).first()[0] >= 0.8
    # Three scenes underestimate a variance; a floor near the noise keeps topics together.
    out = G.segment(df, G.Config(sigma0_sq=0.01, sigma_min_sq=0.003), keep=["label"])
    assert metrics.adjusted_rand(out, "label", "topic", "seq_id").agg({"ari": "min"}).first()[0] >= 0.9


def test_stickiness_keeps_noisy_scenes_together(spark):
    rng = np.random.default_rng(0)
    out = G.segment(frame(spark, [blocks(rng, [10], [0], d=8, noise=0.05, k=1)])).collect()
    assert {(r["topic"], r["is_boundary"]) for r in out} == {(0, False)}


def test_invalid_parameters():
    with pytest.raises(ValueError):
        G.Config(alpha=0.0)
    with pytest.raises(ValueError):
        G.Config(scorer="other")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 25), st.integers(0, 10_000), st.integers(1, 6), st.sampled_from(range(len(CASES) - 3)))
def test_topic_ids_are_dense_and_boundaries_mark_changes(n, seed, size, case):
    x, _ = wandering(np.random.default_rng(seed), n)
    runner, topics, flags = G.BatchRunner([CASES[case]]), [], []
    for i in range(0, n, size):
        part = x[i:i + size]
        empty = [frozenset()] * len(part)
        t, c = runner.run([0] * len(part), part, empty, empty)
        topics += t[:, 0].tolist()
        flags += c[:, 0].tolist()
    assert flags == [i > 0 and topics[i] != topics[i - 1] for i in range(n)]
    seen = -1
    for t in topics:
        assert t <= seen + 1
        seen = max(seen, t)


#: Hash buckets of the words of three turns: the third is as much like the first as like the second.
TIED = [
    {3: 1, 4: 3, 9: 1, 11: 1, 17: 1, 21: 1, 26: 1, 27: 2, 35: 1, 39: 1, 42: 1, 50: 1, 51: 1, 53: 1, 59: 1, 63: 1},
    {2: 1, 3: 1, 14: 1, 15: 1, 17: 1, 26: 1, 29: 1, 30: 1, 34: 2, 40: 1, 41: 1, 49: 1, 51: 1, 54: 1, 59: 1},
    {11: 1, 15: 1, 47: 1},
    {1: 2, 2: 1, 4: 2, 5: 2, 6: 1, 7: 1, 9: 1, 11: 5, 15: 2, 16: 2, 18: 2, 20: 1, 21: 2, 22: 1, 25: 1, 27: 1, 28: 1, 29: 2,
     30: 2, 32: 1, 33: 1, 35: 2, 36: 1, 37: 1, 38: 1, 40: 1, 46: 3, 48: 1, 49: 1, 51: 2, 52: 1, 53: 1, 55: 1, 56: 1, 57: 1, 58: 1, 61: 1, 62: 1},
]


def test_signals_that_tie_are_chosen_as_the_sql_does():
    import duckdb

    from eventide.plans.recursion_sql import assignment_ctes

    con, rng = duckdb.connect(), np.random.default_rng(5)
    configs = [G.Config(alpha=1.0, lmda=l, new_score=nb, scorer="signals", k_max=k) for l in (0.0, 0.3) for nb in (0.3, 0.9) for k in (2, 64)]
    sequences = [[np.bincount(list(t), list(t.values()), 64) for t in TIED]]
    # Few words, many repeats: most scores tie with others.
    sequences += [list(rng.integers(0, 2, (n, 6)).astype(float).repeat(10, axis=1)) for n in (12,) * 30]
    rows = []
    for s, turns in enumerate(sequences):
        for pos, c in enumerate(turns):
            c = np.append(c, np.zeros(64 - len(c)))
            rows.append((s, pos, (c / np.sqrt(c @ c) if c.any() else c).tolist()))
    con.execute("create table src (seq_id bigint, pos bigint, scene double[], tokens varchar[], entities varchar[])")
    con.executemany("insert into src values (?, ?, ?, [], [])", rows)
    want = con.execute(f"with recursive {assignment_ctes('src', configs)} select topic from walk order by seq_id, pos, cfg_id").fetchall()
    none = [frozenset()] * len(rows)
    got = G.BatchRunner(configs).run([r[0] for r in rows], np.array([r[2] for r in rows]), none, none)[0]
    assert got.ravel().tolist() == [t for t, in want]


def test_signal_configurations_share_one_copy(spark, data, monkeypatch):
    sequences, tokens, entities = data
    rows = [
        (s, i, [float(v) for v in x[i]], str(y[i]), tokens[s][i], entities[s][i])
        for s, (x, y) in enumerate(sequences) for i in range(len(x))
    ]
    df = spark.createDataFrame(rows, "seq_id bigint, pos bigint, scene array<double>, label string, tokens array<string>, entities array<string>")
    seen, in_order = [], G.in_order
    monkeypatch.setattr(G, "in_order", lambda rows, **kw: seen.append(rows) or in_order(rows, **kw))
    G.grid_counts(df, G.signal_grid())
    assert seen[0].count() == len(rows)
    few = G.signal_grid()[::40]
    counts = lambda grid: sorted(map(tuple, grid.collect()))
    assert counts(G.grid_counts(df, few)) == counts(G.grid_counts(df, few, per_copy=2))


def test_a_grid_holds_few_sequences_at_a_time(monkeypatch):
    """A full Arrow batch of short sequences: the arrays of a bank stay below 64 MB."""
    sizes, run = [], G.Bank.take

    def watched(bank, sequence):
        sizes.append(sum(getattr(bank, n).nbytes for n in bank._SLOTTED if getattr(bank, n) is not None))
        return run(bank, sequence)

    monkeypatch.setattr(G.Bank, "take", watched)
    rng = np.random.default_rng(2)
    # The last sequence is in the first chunk, which is as large as any.
    keys = [s for s in range(60) for _ in range(24 + (s == 59))]
    x = rng.normal(size=(len(keys), 64))
    none = [frozenset()] * len(keys)
    G.BatchRunner(G.gauss_grid()).run(keys, x, none, none)
    assert 0 < max(sizes) < 64e6
