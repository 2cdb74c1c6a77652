import numpy as np
import pytest

from eventide.operators import segment as G
from eventide.operators.resume import handed_over, resume
from eventide.streaming.segment import append_turns, hand_over, segment_stream, unfinished
from planted import wandering

SCHEMA = "seq_id bigint, pos int, scene array<double>, tokens array<string>, entities array<string>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    return [wandering(rng, n, d=5, k=3) for n in (25, 4, 11)]


def run(spark, tmp_path, parts, config, shuffle_seed=0, **options):
    """Write each part as one file and stream one file per micro-batch."""
    source = tmp_path / "in"
    for i, part in enumerate(parts):
        rows = list(part)
        np.random.default_rng(shuffle_seed + i).shuffle(rows)
        spark.createDataFrame([tuple(r) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"p{i:03d}"))
    stream = (
        spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
        .option("latestFirst", "false").parquet(str(source))
    )
    append_turns(segment_stream(stream, config, **options), str(tmp_path / "out"), str(tmp_path / "ckpt"), 2).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def rows_of(data):
    words = lambda n, step: [f"w{(n * step + j) % 7}" for j in range(n % 4)]
    return [
        (s, i, [float(v) for v in x[i]], words(i, 3), words(i, 5)) for s, (x, _) in enumerate(data) for i in range(len(x))
    ]


def answers(rows):
    return {(r["seq_id"], r["pos"]): (r["topic"], r["is_boundary"]) for r in rows.collect()}


@pytest.mark.parametrize("split, scorer", [(1, "gauss-origin"), (4, "gauss-global"), (3, "ema"), (3, "last"), (4, "max_c_l"), (3, "signals")])
def test_any_split_equals_the_batch_operator(spark, tmp_path, data, split, scorer):
    config = G.Config(alpha=1.0, lmda=3.0, sigma0_sq=0.03, scorer=scorer, new_score=0.5, b_jac=0.4, b_ent=0.3)
    rows = rows_of(data)
    # Rows land in random parts, so positions arrive out of order across micro-batches.
    place = np.random.default_rng(split).integers(0, split, size=len(rows))
    parts = [[r for r, p in zip(rows, place) if p == k] for k in range(split)]
    out = run(spark, tmp_path, parts, config)
    got, want = answers(out), answers(G.segment(spark.createDataFrame(rows, SCHEMA), config))
    assert got == want and out.agg({"late": "max"}).first()[0] == 0


def test_late_rows_are_counted_and_dropped(spark, tmp_path, data):
    rows = [r for r in rows_of(data) if r[0] == 1]
    out = run(spark, tmp_path, [rows[:2], rows[:1], rows[2:]], G.Config())
    assert sorted(r["pos"] for r in out.collect()) == [0, 1, 2, 3]
    assert out.agg({"late": "max"}).first()[0] == 1


CASES = ["gauss-global", "last", "signals"]


def halves(spark, data):
    rows = rows_of(data)
    # Sequence 1 ends in the first part, and sequence 2 begins in the second one.
    first = [r for r in rows if r[0] == 1 or (r[0] == 0 and r[1] < 11)]
    return rows, first, [r for r in rows if r not in first]


@pytest.mark.parametrize("scorer", CASES)
def test_two_runs_equal_one(spark, data, scorer):
    config = G.Config(alpha=1.0, lmda=3.0, sigma0_sq=0.03, scorer=scorer, new_score=0.5, b_jac=0.4, b_ent=0.3)
    rows, first, second = (spark.createDataFrame(r, SCHEMA) for r in halves(spark, data))
    whole = answers(G.segment(rows, config))
    state = handed_over(first, config)
    got = answers(resume(first, None, config)) | answers(resume(second, state, config))
    assert got == whole
    again = sorted(map(repr, handed_over(second, config, state).collect()))
    assert len(again) == handed_over(rows, config).count()
    assert answers(resume(first.limit(0), state, config)) == {}


@pytest.mark.parametrize("scorer", CASES)
def test_a_stream_goes_on_from_a_table_and_leaves_one(spark, tmp_path, data, scorer):
    config = G.Config(alpha=1.0, lmda=3.0, sigma0_sq=0.03, scorer=scorer, new_score=0.5, b_jac=0.4, b_ent=0.3)
    rows, first, second = halves(spark, data)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    got = answers(run(spark, tmp_path / "a", [first[::2], first[1::2]], config))
    state = hand_over(spark, str(tmp_path / "a" / "ckpt"))
    state.write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    got |= answers(run(spark, tmp_path / "b", [second[::2], second[1::2]], config, start=state))
    assert got == answers(G.segment(spark.createDataFrame(rows, SCHEMA), config))


def test_a_timer_closes_a_gap_while_the_stream_runs(spark, tmp_path, data):
    rows = [r for r in rows_of(data) if r[0] == 2 and r[1] not in (3, 4)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = append_turns(
        segment_stream(stream, G.Config(), gap_seconds=1), str(tmp_path / "out"), str(tmp_path / "ckpt"), 2, processingTime="1 second"
    )
    try:
        for _ in range(90):
            query.awaitTermination(1)
            found = spark.read.schema("seq_id bigint, pos bigint, topic int, is_boundary boolean").parquet(str(tmp_path / "out"))
            if found.count() == len(rows):
                break
    finally:
        query.stop()
    assert answers(found) == answers(G.segment(spark.createDataFrame(rows, SCHEMA), G.Config()))
    assert unfinished(spark, str(tmp_path / "ckpt"), G.Config()).count() == 0


class _Store:
    """State in memory that counts the calls."""

    def __init__(self):
        self.calls, self.names = 0, {}

    def _named(self, name, *_):
        return self.names.setdefault(name, _Cell(self))

    getValueState = getMapState = getListState = _named


class _Cell:
    def __init__(self, store):
        self.store, self.map = store, {}

    def _call(self, act):
        self.store.calls += 1
        return act()

    def exists(self): return self._call(lambda: None in self.map)
    def get(self): return self._call(lambda: self.map[None])
    def update(self, value): return self._call(lambda: self.map.update({None: value}))
    def containsKey(self, key): return self._call(lambda: key in self.map)
    def getValue(self, key): return self._call(lambda: self.map.get(key))
    def updateValue(self, key, value): return self._call(lambda: self.map.update({key: value}))


def test_calls_to_the_state_do_not_grow_with_the_words():
    import pandas as pd

    from eventide.streaming.segment import TopicProcessor

    config, rng, calls = G.Config(scorer="signals", new_score=0.9, b_jac=2.0, b_ent=1.0, k_max=8), np.random.default_rng(6), []
    clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: 0})()
    for words in (4, 400):
        x = rng.normal(size=(12, 5))
        sets = [[[f"{c}{w}" for w in rng.choice(3 * words, words, replace=False)] for _ in x] for c in "te"]
        store, got = _Store(), []
        for part in (slice(0, 5), slice(5, 12)):  # two micro-batches
            processor = TopicProcessor(config)
            processor.init(store)
            rows = pd.DataFrame({"pos": np.arange(12)[part], "scene": list(x[part]), "tokens": sets[0][part], "entities": sets[1][part]})
            for frame in processor.handleInputRows((1, False), iter([rows]), clock):
                got += frame["topic"].tolist()
        want = G.BatchRunner([config]).run([1] * 12, x, *[[frozenset(v) for v in s] for s in sets])[0][:, 0]
        assert got == want.tolist()
        calls.append(store.calls)
    assert max(calls) <= 80
