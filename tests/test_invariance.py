"""Results must not depend on file count, list length, table size, batch layout or a common offset."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import binding as B, memory as Y, metrics as M, moments as O, responses as P, retrieval as R, running as U, sweep as S
from eventide.plans import catalog


def scenes_of(spark, sequences, labels=None):
    rows = [(s, p, [float(v) for v in np.atleast_1d(x)], (labels or {}).get(s, "a")) for s, xs in sequences.items() for p, x in enumerate(xs)]
    return spark.createDataFrame(rows, "seq_id bigint, pos bigint, scene array<double>, label string")


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_a_sequence_leaves_its_neighbours_alone(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        odd = scenes_of(spark, {1: [1.0, float("nan"), 1e17], 2: [0.0, 1.0], 3: [1e17, 1.0], 4: [0.25, 0.75, 0.5]}).coalesce(1)
        got = {(r.seq_id, r.pos): r["mean"][0] for r in U.running_mean(odd).collect()}
        assert [got[2, 0], got[2, 1], got[4, 0], got[4, 1], got[4, 2]] == [0.0, 0.5, 0.25, 0.5, 0.5]
        scored = {(r.seq_id, r.pos): r.loglik for r in U.running_scores(odd, 1.0).collect()}
        alone = {(r.seq_id, r.pos): r.loglik for r in U.running_scores(odd.where("seq_id in (2, 4)"), 1.0).collect()}
        assert {k: scored[k] for k in alone} == alone
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rows", [3, 65_536])
def test_a_common_offset_cancels(spark, rows):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(20, 2))
    exact = {(r.pos): r.m2_before for r in U.running_topic_state(scenes_of(spark, {1: x}), rows).collect()}
    shifted = {(r.pos): r.m2_before for r in U.running_topic_state(scenes_of(spark, {1: x + 1e8}), rows).collect()}
    for p, want in exact.items():
        assert shifted[p] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_merge_keeps_digits_at_an_offset(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(30, 2)) + 1e8
    parts = [("g", len(p), p.mean(0).tolist(), ((p - p.mean(0)) ** 2).sum(0).tolist()) for p in np.split(x, [4, 11])]
    df = spark.createDataFrame([*parts, (None, 2, [1e8, 0.0], [0.5, 0.5])], "k string, n bigint, mu array<double>, m2 array<double>")
    got = {r.k: r for r in O.merge_moments(df, "k").collect()}
    assert got["g"].m2 == pytest.approx(((x - x.mean(0)) ** 2).sum(0).tolist(), rel=1e-6) and got["g"].n == 30
    assert got[None].m2 == [0.5, 0.5]


@pytest.mark.parametrize("count", [64, 65])
def test_null_scores_count_nowhere(spark, count):
    df = spark.createDataFrame([(True, None), (True, 0.1), (False, 0.2), (True, 5.0)], "gt boolean, score double")
    rows = S.threshold_sweep(df, [0.5 + k / 1000 for k in range(count)]).collect()
    assert {(r.tp, r.fp, r.fn) for r in rows} == {(1, 1, 1)}


def test_cleanup_routes_agree_with_repeated_keys(spark):
    draw = np.random.default_rng(2)
    vocabulary = spark.createDataFrame([(f"w{k:03}", draw.normal(size=8).tolist()) for k in range(60)], "name string, vec array<double>")
    vectors = [draw.normal(size=8).tolist() for _ in range(4)]
    queries = spark.createDataFrame([(1, vectors[0]), (1, vectors[1]), (1, vectors[1]), (2, vectors[2]), (None, vectors[3])], "q int, vec array<double>")
    rows = lambda df: sorted(((r.q, r["rank"], r.name, round(r.prob, 9)) for r in df.collect()), key=repr)
    direct = rows(B.cleanup(queries, vocabulary, 3, gamma=2.0))
    assert len(direct) == 15
    assert rows(B.cleanup(queries, vocabulary, 3, gamma=2.0, blocks=(2, 3))) == direct
    assert rows(B.cleanup(queries, vocabulary, 3, gamma=2.0, max_cells=100)) == direct


def test_tiles_do_not_change_the_nearest(monkeypatch):
    draw = np.random.default_rng(3)
    x, table = draw.integers(0, 3, (9, 4)).astype(float), draw.integers(0, 3, (50, 4)).astype(float)
    names = [f"n{k:02}" for k in range(50)]
    whole = B._nearest(x, table, names, 5, 1.0, "euclidean")
    monkeypatch.setattr(B, "TILE", (4, 7))
    parts = B._nearest(x, table, names, 5, 1.0, "euclidean")
    assert [[c["name"] for c in row] for row in whole[0]] == [[c["name"] for c in row] for row in parts[0]]
    assert np.allclose(np.log(whole[2]) + whole[1], np.log(parts[2]) + parts[1])


def test_logsumexp_groups(spark):
    df = spark.createDataFrame([("a", 1000.0), ("a", 999.5), (None, -3.0), (None, None), ("b", float("-inf"))], "k string, v double")
    got = {r.k: r.logsumexp for r in M.logsumexp(df, "v", "k").collect()}
    assert got["a"] == pytest.approx(1000 + math.log(1 + math.exp(-0.5))) and got[None] == pytest.approx(-3.0) and got["b"] == float("-inf")
    assert M.logsumexp(df, "v").first()["logsumexp"] == pytest.approx(got["a"])


def test_permutations_of_a_movie_without_flags(spark):
    df = spark.createDataFrame([("m", b, float(b), False) for b in range(5)] + [("f", b, float(b), b == 2) for b in range(5)], "movie string, bin int, value double, flag boolean")
    rows = P.permutation_null(df, 3).collect()
    assert sorted((r.movie, r.p) for r in rows) == [(m, p) for m in "fm" for p in range(3)]
    assert all((r.r_pb is None) == (r.movie == "m") for r in rows)


def test_relative_distance_keeps_null_labels(spark):
    scenes = scenes_of(spark, {1: [0.0, 2.0]}, {1: None})
    rebuilt = spark.createDataFrame([(1, 0, [0.5]), (1, 1, [1.5])], "seq_id bigint, pos bigint, mean array<double>")
    assert Y.relative_distance(rebuilt, scenes).first()["rows"] == 2


@pytest.mark.parametrize("files", [1, 24])
def test_stream_counts_do_not_depend_on_files(spark, tmp_path, files):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / str(files))
    events.withColumn("_r", F.rand(7)).repartition(files).sortWithinPartitions("_r").drop("_r").write.parquet(os.path.join(folder, "events.parquet"))
    got = {(r.event_type, r.day): r.n for r in catalog.QUERIES["stream_counts"](spark, folder).collect()}
    want = {(r.event_type, r.day): r.n for r in events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_best_attainable_uses_every_bin(spark):
    df = spark.createDataFrame([("m", b, 1.0 if b < 300 else 0.0) for b in range(400)], "movie string, bin int, rate double")
    assert P.best_attainable(df).first()["r_pb"] == pytest.approx(1.0)
    assert P.best_attainable(df, 250).first()["r_pb"] < 0.9


def test_v_measure(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), (None, 3)], "t string, p int")
    r = M.v_measure(df, "t", "p").first()
    assert (r.rows, r.homogeneity, r.completeness, r.v_measure) == (4, 1.0, 1.0, 1.0)
    split = M.v_measure(spark.createDataFrame([("x", 1), ("x", 2)], "t string, p int"), "t", "p").first()
    assert split.homogeneity == 1.0 and split.completeness == pytest.approx(0.0)


def test_retrieval_over_blocks(spark):
    draw = np.random.default_rng(4)
    scenes = scenes_of(spark, {1: draw.normal(size=(50, 3)), 2: draw.normal(size=(7, 3))})
    near = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "seq_id bigint, query array<double>")
    rows = scenes.join(near, "seq_id").withColumn("cosine", F.element_at("scene", 1))
    small = R._top(rows, 4, F.col("cosine"), "pos", rows_per_block=3).select("seq_id", "pos", "rank").collect()
    large = R._top(rows, 4, F.col("cosine"), "pos").select("seq_id", "pos", "rank").collect()
    assert sorted(small) == sorted(large) and len(small) == 8


@pytest.mark.parametrize("rows", [3, 65_536])
def test_known_token_counts_match_the_sets(spark, rows):
    draw = np.random.default_rng(6)
    turns = [(s, p, draw.choice(["a", "b", None]), [f"t{v}" for v in set(draw.integers(0, 9, draw.integers(0, 4)))]) for s in (1, 2) for p in range(20)]
    df = spark.createDataFrame([(s, p, None if k is None else str(k), t) for s, p, k, t in turns], "seq_id bigint, pos bigint, label string, tokens array<string>")
    got = {(r.seq_id, r.pos): (r.n_known, r.overlap) for r in U.known_token_counts(df, rows=rows).collect()}
    seen = {}
    for s, p, k, t in turns:
        known = seen.setdefault((s, k), set())
        want = (len(known), len(known & set(t)) / len(known | set(t)) if known and t else 0.0)
        assert got[s, p] == pytest.approx(want)
        known |= set(t)


def test_a_large_topic_model_scores_in_blocks(spark):
    draw = np.random.default_rng(7)
    scenes = scenes_of(spark, {1: draw.normal(size=(30, 3)) + 1e6})
    model = spark.createDataFrame(
        [(k, int(draw.integers(1, 9)), (draw.normal(size=3) + 1e6).tolist(), draw.uniform(1, 4, 3).tolist()) for k in range(11)],
        "topic int, n bigint, mu array<double>, m2 array<double>",
    )
    rows = lambda df: {(r.seq_id, r.pos): (r.topic, r.log_score, r.log_evidence) for r in df.collect()}
    whole, blocks = rows(O.score_scenes(scenes, model, 0.5)), rows(O.score_scenes(scenes, model, 0.5, max_topics=3))
    assert whole.keys() == blocks.keys() and len(whole) == 30
    for key, (topic, score, evidence) in whole.items():
        assert blocks[key][0] == topic and blocks[key][1:] == pytest.approx((score, evidence), rel=1e-9)
