import json

import pytest

from eventide.schema import scene_quality
from eventide.sources import readers as R, sinks as K


def test_factoid_turns(spark, tmp_path):
    turns = [
        {"Conversation_no": 2, "Turn_no": 1, "Question": "q21", "Answer": "a", "Topic": "B", "Topic_section": "s", "Context": [], "is_nq": True},
        {"Conversation_no": 1, "Turn_no": 2, "Question": "q12", "Answer": "a", "Topic": "A", "Topic_section": "s2", "Context": ["q11", "a"]},
        {"Conversation_no": 1, "Turn_no": 1, "Question": "q11", "Answer": "a", "Topic": "A", "Topic_section": "s", "Context": []},
    ]
    (tmp_path / "a.json").write_text(json.dumps(turns, indent=1))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, turns)))
    for name, lines in (("a.json", False), ("b.json", True)):
        rows = R.read_factoid_turns(spark, str(tmp_path / name), lines=lines).collect()
        assert sorted((r["seq_id"], r["pos"], r["text"]) for r in rows) == [(1, 0, "q11"), (1, 1, "q12"), (2, 0, "q21")]
    firsts = R.first_sequences(R.read_factoid_turns(spark, str(tmp_path / "a.json")), 1)
    assert {r["seq_id"] for r in firsts.collect()} == {1}


def test_labelled_dialogs(spark, tmp_path):
    for split in ("train", "test"):
        (tmp_path / split).mkdir()
        (tmp_path / split / f"anno_{split}.json").write_text(json.dumps({"7": [["hi", "-1"], ["yes", "0"], [split, "1"]], "8": [["x", "-1"]]}))
    rows = R.read_labelled_dialogs(spark, str(tmp_path), ("train", "test")).collect()
    assert len(rows) == 8
    assert ("test", "7", 2, "test", "1") in {(r["split"], r["seq_id"], r["pos"], r["text"], r["label"]) for r in rows}


def test_response_files(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("SubjNum\tMovie\tMS\n1\tA\t1500.5\n2\tB\t10\n")
    assert sorted(tuple(r) for r in R.read_responses(spark, str(tmp_path / "r.tsv")).collect()) == [(1, "A", 1500.5), (2, "B", 10.0)]
    (tmp_path / "c.csv").write_text("0.9, 0\n4.5, 0.25\n")
    assert sorted(tuple(r) for r in R.read_response_curve(spark, str(tmp_path / "c.csv")).collect()) == [(0.9, 0.0), (4.5, 0.25)]


def test_slices_and_quality(spark):
    df = spark.createDataFrame([(s, i, [float(i), 1.0]) for s in (1, 2) for i in range(5)], "seq_id int, pos int, scene array<double>")
    assert R.slice_scenes(df, 1, 3, seq_id=2).count() == 2
    q = scene_quality(df).first()
    assert (q["n_rows"], q["n_sequences"], q["min_dim"], q["max_dim"], q["dense"]) == (10, 2, 2, 2, True)
    assert scene_quality(df.where("pos <> 2")).first()["dense"] is False


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_sinks(spark, tmp_path, fmt):
    metrics = spark.createDataFrame([("m", 0.5)], "method string, f1 double")
    for experiment in ("one", "two"):
        K.write_metrics(metrics, str(tmp_path / "m"), experiment, fmt)
    back = spark.read.format(fmt).load(str(tmp_path / "m"))
    assert {r["experiment"] for r in back.collect()} == {"one", "two"}


def test_turn_table(spark, tmp_path):
    turns = spark.createDataFrame([(s, p, p % 2) for s in range(5) for p in range(4)], "seq_id bigint, pos int, topic int")
    K.write_turns(turns, str(tmp_path / "t"), buckets=3)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 20 and back.select("bucket").distinct().count() <= 3


def test_encoder_hook(spark):
    import numpy as np

    from eventide.operators.encode import encode

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("abc",), ("",), (None,)], "text string")
    got = [r["scene"] for r in encode(df, model=load).collect()]
    assert got[0] == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and got[1] == [0.0, 1.0] == got[2]
    plain = {r["text"]: r["scene"] for r in encode(df.where("text is not null"), d=8).collect()}
    assert plain[""] == [0.0] * 8 and sum(v * v for v in plain["abc"]) == pytest.approx(1.0)
