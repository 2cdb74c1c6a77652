"""Near pairs by pivots, components of links, and topic merging, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import metrics, memory, moments, near, responses, retrieval as R


def frame(spark, points):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in points], "id long, vec array<double>")


def reachable(n, pairs):
    first = list(range(n))
    while True:
        new = list(first)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == first:
            return first
        first = new


@pytest.mark.parametrize("pivots,tile", [(1, 7), (5, 1000), (12, 9)])
def test_near_pairs_are_all_near_pairs(spark, pivots, tile):
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(6, 4)) * 3
    x = np.vstack([centres[rng.integers(0, 6, 150)] + 0.3 * rng.normal(size=(150, 4)), np.tile(centres[0], (40, 1))]) + 1e3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    expected = {(i, j) for i in range(190) for j in range(i + 1, 190) if d[i, j] <= 0.5}
    got = near.near_pairs(frame(spark, enumerate(x)), 0.5, pivots=pivots, tile=tile).collect()
    assert {(r.a, r.b) for r in got} == expected and len(got) == len(expected)
    assert all(abs(r.distance - d[r.a, r.b]) < 1e-9 for r in got)
    links = near.near_pairs(frame(spark, enumerate(x)), 0.5, links=True, pivots=pivots, tile=tile).select("a", "b").collect()
    assert reachable(190, links) == reachable(190, expected)


def test_a_crowd_of_copies_gives_few_links(spark):
    x = np.tile(np.arange(3.0), (600, 1))
    links = near.near_pairs(frame(spark, enumerate(x)), 0.1, links=True, tile=100).count()
    assert 599 <= links < 600 * 7


def test_cosine_pairs_with_zero_and_null_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [5.0, 0.1]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 0.0]), (5, [-1.0, 0.0])]
    points = spark.createDataFrame(rows, "id long, vec array<double>")
    assert [(r.a, r.b) for r in near.near_pairs(points, 0.01, "cosine").collect()] == [(1, 2)]
    assert sorted((r.a, r.b) for r in near.near_pairs(points, 1.0, "cosine").collect()) == [(1, 2), (1, 3), (2, 3), (3, 5)]
    assert near.near_pairs(points.limit(0), 1.0).collect() == []


@pytest.mark.parametrize("pairs", [
    [(k, k + 1) for k in range(200)],
    [(0, k) for k in range(1, 300)] + [(300, k) for k in range(250, 260)],
    [(k, k ^ 1) for k in range(0, 100, 2)] + [(7, 7)],
    [((k * 37) % 101, ((k + 1) * 37) % 101) for k in range(80)],
])
def test_components_of_chain_hub_and_pairs(spark, pairs):
    got = near.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    ids = {i for p in pairs if p[0] != p[1] for i in p}
    first = reachable(max(max(p) for p in pairs) + 1, pairs)
    assert {r.id: r["first"] for r in got} == {i: first[i] for i in ids} and len(got) == len(ids)


def test_topics_merge_over_a_chain_and_a_hub(spark):
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))]
    # A chain of small steps, a hub of copies, one topic too small to merge, one alone.
    angles = [(i, 5, 0.1 * i) for i in range(8)] + [(20 + i, 5, 3.0) for i in range(30)] + [(60, 1, 3.0), (61, 9, 5.0)]
    topics = spark.createDataFrame([(i, n, turn(a)) for i, n, a in angles], "id long, n long, centroid array<double>")
    got = {r.id: r["first"] for r in R.topic_merges(topics, float(np.cos(0.11)), least_turns=2).collect()}
    assert got == {**{i: 0 for i in range(8)}, **{20 + i: 20 for i in range(30)}, 60: 60, 61: 61}
    moments_of = topics.select("id", "n", F.col("centroid").alias("mu"), F.array(F.lit(1.0), F.lit(2.0)).alias("m2"))
    merged = {r["first"]: r for r in R.merged_topics(moments_of, R.topic_merges(topics, float(np.cos(0.11)), 2)).collect()}
    x = np.array([turn(0.1 * i) for i in range(8)])
    assert merged[0].n == 40 and merged[0].topics == 8
    assert np.allclose(merged[0].mu, x.mean(0)) and np.allclose(merged[0].m2, 8 * np.array([1.0, 2.0]) + 5 * ((x - x.mean(0)) ** 2).sum(0))


def scenes_of(spark, keys):
    rng = np.random.default_rng(3)
    rows = [(s, p, l, rng.normal(size=3).tolist()) for s, p, l in keys]
    return spark.createDataFrame(rows, "seq_id long, pos long, label int, scene array<double>")


def test_null_keys_are_keys(spark):
    scenes = scenes_of(spark, [(s, p, None if p == 2 else p % 2) for s in (None, 1) for p in range(4)])
    queries = spark.createDataFrame([(None, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0])], "seq_id long, query array<double>")
    count = lambda df: sorted(((r.seq_id is None), n) for r, n in [(r, r["count"]) for r in df.groupBy("seq_id").count().collect()])
    assert count(R.nearest_topics(scenes, queries, 3)) == [(False, 3), (True, 3)]
    assert count(R.nearest_turns(scenes, queries, 9)) == [(False, 4), (True, 4)]
    assert count(R.memory_window(scenes, queries, 3, 9)) == [(False, 4), (True, 4)]
    pairs = spark.createDataFrame([(None, 1, 1), (None, 2, 2), ("x", 1, 1), ("x", 1, 2)], "g string, t int, p int")
    assert {r.g: r.rows for r in metrics.adjusted_rand(pairs, "t", "p", "g").collect()} == {None: 2, "x": 2}
    bins = spark.createDataFrame([(m, b, float(b), b < 2) for m in (None, "m") for b in range(5)], "movie string, bin long, value double, flag boolean")
    null = responses.permutation_null(bins, 3).collect()
    assert sorted((r.movie is None, r.p) for r in null) == sorted((m, p) for m in (False, True) for p in range(3))
    traces = spark.createDataFrame([(None, 0, [1.0], None, 0), (1, 0, [1.0], None, 0)], "seq_id long, trace_id long, x array<double>, e int, t int")
    slots = spark.createDataFrame([(None, 0, [1.0], 1), (1, 0, [1.0], 1)], "seq_id long, pos int, scene array<double>, label int")
    assert memory.match_slots(traces, slots, 0).count() == 2
    samples = spark.createDataFrame([(0, None, [1.0]), (0, 1, [1.0])], "sample_id int, seq_id long, x array<double>")
    assert [r.recall for r in memory.recall(samples, traces, 1).collect()] == [1.0, 1.0]


def test_repeated_scenes_score_alike_on_both_routes(spark):
    scenes = scenes_of(spark, [(1, 0, 0), (1, 1, 0), (None, 0, 1)])
    scenes = scenes.unionByName(scenes.where("pos = 0"))
    rng = np.random.default_rng(1)
    model = spark.createDataFrame([(t, 5, rng.normal(size=3).tolist(), [1.0, 2.0, 3.0]) for t in range(7)], "topic int, n long, mu array<double>, m2 array<double>")
    key = lambda df: sorted((repr((r.seq_id, r.pos, r.topic)), round(r.log_score, 9), round(r.log_evidence, 9)) for r in df.collect())
    one = key(moments.score_scenes(scenes, model, 0.1))
    assert len(one) == 5 and key(moments.score_scenes(scenes, model, 0.1, max_topics=2)) == one
