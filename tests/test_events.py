import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import events as N, moments as M
from planted import frame, wandering


def lse(v):
    m = max(v)
    return m + math.log(sum(math.exp(x - m) for x in v))


def density(x, mu, v):
    return float(-0.5 * np.sum((x - mu) ** 2 / v + np.log(2 * math.pi * v)))


def walk(x, alfa, lmda, nu0, var0, start=()):
    """The published recursion for the mean/variance model, scene by scene."""
    d, mode = x.shape[1], nu0 * var0 / (nu0 + 2)
    groups = [list(g) for g in start]
    prev, out, before = None, [], None

    def var(g):
        return (nu0 * var0 + len(g) * np.var(g, axis=0)) / (nu0 + len(g) + 2) if len(g) > 1 else np.full(d, mode)

    for s in x:
        lik = [density(s, np.mean(g, axis=0), var(g)) for g in groups] + [density(s, np.zeros(d), np.full(d, mode))]
        prior = [float(len(g)) for g in groups] + [alfa]
        row = {}
        if prev is None:
            k, opens = int(np.argmax(np.log(prior) + lik)), True
            row |= {"log_like": [0.0], "log_prior": [alfa], "post": [1.0], "lbp": 0.0, "pe": 0.0}
        else:
            restart, repeat = lik[prev] + math.log(prior[prev]), lik[prev] + math.log(prior[prev] + lmda)
            post = [math.log(p) + l for p, l in zip(prior, lik)]
            post[prev] = max(restart, repeat)
            k = int(np.argmax(post))
            opens = k != prev or restart > repeat
            post[prev] = restart
            row["lbp"] = lse(post) - lse(post + [repeat])
            row["pe"] = float(np.linalg.norm(s - np.mean(groups[prev], axis=0)))
            lik[prev] = lse([lik[prev], lik[prev]])
            prior[prev] += lmda / 2
            joint = [math.log(p) + l for p, l in zip(prior, lik)]
            row |= {"log_like": lik, "log_prior": list(np.log(prior)), "post": [math.exp(j - lse(joint)) for j in joint]}
        joint = [a + b for a, b in zip(row["log_like"], row["log_prior"])]
        row |= {"topic": k, "opens": opens, "log_loss": lse(joint), "e_hat": int(np.argmax(joint))}
        if before is None:
            row["surprise"] = 0.0
        else:
            z = lse(before)
            row["surprise"] = lse([b - z + l for b, l in zip(before, row["log_like"])])
        before = joint
        if k == len(groups):
            groups.append([])
        groups[k].append(s)
        prev = k
        out.append(row)
    return out


@pytest.fixture(scope="module")
def sequences():
    rng = np.random.default_rng(4)
    return [wandering(rng, n, d=6, k=3) for n in (30, 1, 12)]


CONFIG = N.EventConfig(alfa=0.7, lmda=3.0, var_df0=10.0, var_scale0=0.06)


def check(rows, want):
    for r, w in zip(rows, want):
        assert (r["topic"], r["is_boundary"], r["e_hat"]) == (w["topic"], w["opens"], w["e_hat"])
        for name, key in (("log_like", "log_like"), ("log_prior", "log_prior"), ("post", "post"),
                          ("log_boundary_probability", "lbp"), ("pe", "pe"), ("log_loss", "log_loss")):
            assert r[name] == pytest.approx(w[key]), name


def test_recursion_and_surprise(spark, sequences):
    full = N.run_events(frame(spark, sequences), CONFIG, full=True).cache()
    surprise = {(r["seq_id"], r["pos"]): r["surprise"] for r in N.event_surprise(full).collect()}
    for s, (x, _) in enumerate(sequences):
        want = walk(x, 0.7, 3.0, 10.0, 0.06)
        rows = sorted(full.where(F.col("seq_id") == s).collect(), key=lambda r: r["pos"])
        check(rows, want)
        assert [surprise[s, i] for i in range(len(x))] == pytest.approx([w["surprise"] for w in want])


def test_first_scene_special_values(spark, sequences):
    first = N.run_events(frame(spark, sequences), CONFIG, full=True).where("seq_id = 0 and pos = 0").first()
    assert first["log_like"] == [0.0] and first["post"] == [1.0] and first["log_boundary_probability"] == 0.0
    # Published as is: the value is alfa, not its logarithm.
    assert first["log_prior"] == [0.7] and first["log_loss"] == pytest.approx(0.7)


def test_warm_start_of_one_and_of_each_sequence(spark, sequences):
    rng = np.random.default_rng(8)
    start = [rng.normal(scale=0.3, size=(n, 6)) for n in (5, 4)]
    rows = [(k, len(g), g.mean(axis=0).tolist(), (np.var(g, axis=0) * len(g)).tolist()) for k, g in enumerate(start)]
    model = spark.createDataFrame(rows, "topic int, n bigint, mu array<double>, m2 array<double>")
    df = frame(spark, sequences).cache()
    shared = N.run_events(df, CONFIG, full=True, model=model)
    own = model.withColumn(
        "seq_id", F.explode(F.array(*[F.lit(s).cast("bigint") for s in range(len(sequences))]))
    )
    each = N.run_events(df, CONFIG, full=True, warm=own)
    for s, (x, _) in enumerate(sequences):
        want = walk(x, 0.7, 3.0, 10.0, 0.06, start)
        for out in (shared, each):
            check(sorted(out.where(F.col("seq_id") == s).collect(), key=lambda r: r["pos"]), want)


def test_prior_log_probability_zero_counts_as_unset():
    x = np.array([0.3, -0.1])
    unset = N.untrained_loglik(x, 0.5, None)
    assert N.untrained_loglik(x, 0.5, 0.0) == unset == pytest.approx(density(x, np.zeros(2), np.full(2, 0.5)))
    assert N.untrained_loglik(x, 0.5, -3.0) == -3.0


def test_known_events(spark, sequences):
    x, y = sequences[0]
    token = np.concatenate([[0], np.cumsum(np.diff(y) != 0)])
    df = frame(spark, [sequences[0]])
    tokens = {(0, i): int(t) for i, t in enumerate(token)}
    lookup = spark.createDataFrame([(s, i, t) for (s, i), t in tokens.items()], "seq_id bigint, pos int, token_id int")
    got = sorted(N.run_events_with_tokens(df.join(lookup, ["seq_id", "pos"]), CONFIG).collect(), key=lambda r: r["token_id"])
    d, mode, groups, counts, prev = 6, 0.05, [], [], None
    for r in got:
        part = x[token == r["token_id"]]
        v = lambda g: (0.6 + len(g) * np.var(g, axis=0)) / (12 + len(g)) if len(g) > 1 else np.full(d, mode)
        joint = [math.log(c + (3.0 if k == prev else 0)) + sum(density(s, np.mean(g, axis=0), v(g)) for s in part)
                 for k, (g, c) in enumerate(zip(groups, counts))]
        joint.append(math.log(0.7) + sum(density(s, np.zeros(d), np.full(d, mode)) for s in part))
        k = int(np.argmax(joint))
        assert (r["topic"], r["n_scenes"]) == (k, len(part)) and r["log_loss"] == pytest.approx(lse(joint))
        if k == len(groups):
            groups.append([])
            counts.append(0)
        groups[k] += list(part)
        counts[k] += len(part)
        prev = k
    # Models without a summary keep the scenes of the open event and give as many rows.
    plugged = N.EventConfig(alfa=0.7, lmda=3.0, factory=N.LastSceneModel)
    assert N.run_events_with_tokens(df.join(lookup, ["seq_id", "pos"]), plugged).count() == len(got)


def test_plugged_model_restarts(spark):
    """A model whose next-scene prediction is bad opens a new event of the same type."""
    x = np.array([[1.0, 0.0], [0.95, 0.05], [-1.0, 0.0], [1.0, 0.0], [0.97, 0.02]])
    config = N.EventConfig(alfa=1e-6, lmda=0.5, var_df0=10.0, var_scale0=0.06, factory=N.LastSceneModel)
    rows = sorted(N.run_events(frame(spark, [(x, [0] * 5)]), config).collect(), key=lambda r: r["pos"])
    assert rows[0]["is_boundary"] and not rows[1]["is_boundary"]
    assert rows[2]["pe"] == pytest.approx(math.dist(x[1], x[2]))


def test_plugged_recursion_against_loops(spark, sequences):
    """The last-scene model, with every candidate, restart and error written out."""
    x = sequences[0][0]
    alfa, lmda, nu0, var0, d = 0.7, 3.0, 10.0, 0.06, 6
    mode = nu0 * var0 / (nu0 + 2)
    config = N.EventConfig(alfa=alfa, lmda=lmda, var_df0=nu0, var_scale0=var0, factory=N.LastSceneModel)
    got = sorted(N.run_events(frame(spark, [sequences[0]]), config).collect(), key=lambda r: r["pos"])
    counts, starts, errors, prev = [], [], [], None

    def spread(k):
        e = errors[k]
        return (nu0 * var0 + len(e) * np.var(e, axis=0)) / (nu0 + len(e) + 2) if len(e) > 1 else np.full(d, mode)

    for i, (s, r) in enumerate(zip(x, got)):
        first = [density(s, np.mean(starts[k], axis=0), spread(k)) for k in range(len(counts))]
        first.append(density(s, np.zeros(d), np.full(d, mode)))
        prior = counts + [alfa]
        score = [math.log(p) + l for p, l in zip(prior, first)]
        opens = True
        if prev is not None:
            repeat = math.log(counts[prev] + lmda) + density(s, x[i - 1], spread(prev))
            restart = score[prev]
            score[prev] = max(restart, repeat)
            opens = restart > repeat
        k = int(np.argmax(score))
        opens = opens or k != prev
        assert (r["topic"], r["is_boundary"]) == (k, opens)
        if k == len(counts):
            counts.append(0)
            starts.append([])
            errors.append([])
        counts[k] += 1
        if opens:
            if starts[k]:
                errors[k].append(s - np.mean(starts[k], axis=0))
            starts[k].append(s)
        else:
            errors[k].append(s - x[i - 1])
        prev = k


def test_pretraining_and_scoring(spark, sequences):
    df = frame(spark, sequences).withColumn("is_boundary", (F.col("pos") % 4) == 0).cache()
    model = {r["topic"]: r for r in M.pretrain(df).collect()}
    x = np.concatenate([s[0] for s in sequences])
    y = np.concatenate([s[1] for s in sequences])
    opens = np.concatenate([np.arange(len(s[0])) % 4 == 0 for s in sequences])
    for k in set(y.tolist()):
        mine = x[y == k]
        assert model[k]["n"] == len(mine) and model[k]["mu"] == pytest.approx(mine.mean(axis=0).tolist())
        assert model[k]["m2"] == pytest.approx((np.var(mine, axis=0) * len(mine)).tolist())
        first = x[(y == k) & opens]
        assert model[k]["starts"] == len(first)
        if len(first):
            assert model[k]["start_mu"] == pytest.approx(first.mean(axis=0).tolist())
    best = lambda rows: sorted((r["seq_id"], r["pos"], r["topic"]) for r in rows.collect())
    assert best(M.score_scenes(df, M.pretrain(df), 0.05, max_topics=1)) == best(M.score_scenes(df, M.pretrain(df), 0.05))


@pytest.mark.parametrize("factory", [None, N.LastSceneModel])
def test_two_runs_equal_one(spark, sequences, factory):
    config = N.EventConfig(alfa=0.7, lmda=3.0, var_df0=10.0, var_scale0=0.06, factory=factory)
    df = frame(spark, sequences).cache()
    order = lambda rows: sorted(rows.collect(), key=lambda r: (r["seq_id"], r["pos"]))
    want = order(N.run_events(df, config, full=True))
    # The first sequence is over after the first run, the last one begins with the second.
    last = len(sequences) - 1
    early = F.when(F.col("seq_id") == 0, True).when(F.col("seq_id") == last, False).otherwise(F.col("pos") < 7)
    first, second = df.where(early), df.where(~early)
    state = N.handed_over_events(first, config).cache()
    got = order(N.run_events(first, config, full=True).union(N.run_events(second, config, full=True, warm=state)))
    assert [(r["seq_id"], r["pos"], r["topic"], r["is_boundary"]) for r in got] == [(r["seq_id"], r["pos"], r["topic"], r["is_boundary"]) for r in want]
    for g, w in zip(got, want):
        assert g["log_loss"] == pytest.approx(w["log_loss"]) and g["pe"] == pytest.approx(w["pe"]) and g["post"] == pytest.approx(w["post"])
    key = lambda rows: sorted((r["seq_id"], r["topic"], r["n"], r["prev"], tuple(np.round(r["mu"], 9)), tuple(r["x_prev"])) for r in rows.collect())
    assert key(N.handed_over_events(second, config, warm=state)) == key(N.handed_over_events(df, config))
    assert N.run_events(first.limit(0), config, warm=state).count() == 0
