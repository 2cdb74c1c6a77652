"""Handing a segmenter's state from one run to the next.

A state table has one row per topic of a sequence and, for the ``signals`` scorer, one row per token or entity with the
topics that hold it. Batch runs and stopped streams write the same table, and both can start from it, so the
rows of a sequence may be split over any number of runs.

Defined cases: an empty state starts every sequence afresh; a sequence without new rows keeps its state; NULL sequence ids
are one sequence. Rows are taken in the order of ``pos`` (NULL first), gaps and repeats included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventide.operators.ordered import in_order, matrix, stream
from eventide.operators.segment import SIGNALS, Bank, Config, SignalBank, bank_of

#: Columns of a state table besides ``seq_id``. ``kind`` is ``topic`` (then ``topics`` is its id), ``t`` or ``e``.
STATE = (
    "prev int, next_pos bigint, used int, seen double, mean array<double>, kind string, item string, "
    "topics array<int>, n double, mu array<double>, m2 array<double>, last array<double>, n_tok double, n_ent double"
)
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]
TOPIC_COLUMNS = ("n", "mu", "m2", "last", "n_tok", "n_ent")
_FLOATS = pa.list_(pa.float64())
_ARROW = {
    "prev": pa.int32(), "next_pos": pa.int64(), "used": pa.int32(), "seen": pa.float64(), "mean": _FLOATS,
    "kind": pa.string(), "item": pa.string(), "topics": pa.list_(pa.int32()), "n": pa.float64(), "mu": _FLOATS,
    "m2": _FLOATS, "last": _FLOATS, "n_tok": pa.float64(), "n_ent": pa.float64(),
}
#: Rows that a task returns together.
OUT_ROWS = 1000


def put_state(bank: Bank | SignalBank, row: dict) -> None:
    """Add one row of a state table to a bank of one sequence."""
    bank.put_head(row["used"], row["prev"], row["seen"], row["mean"])
    if row["kind"] == "topic":
        bank.put_topic(row["topics"][0], *[row[c] for c in TOPIC_COLUMNS])
    else:
        bank.put_holders(row["kind"], row["item"], row["topics"])


def state_rows(bank: Bank | SignalBank, next_pos: int) -> Iterator[dict]:
    """The rows of a state table for a bank of one sequence."""
    used = int(bank.used[0])
    head = {
        "prev": int(bank.prev[0]), "next_pos": next_pos, "used": used, "seen": float(bank.seen[0]),
        "mean": bank.mean[0].tolist(),
    }
    for k in range(used):
        yield head | {"kind": "topic", "item": "", "topics": [k]} | bank.topic(k)
    empty = {"n": 0.0, "mu": [], "m2": [], "last": [], "n_tok": 0.0, "n_ent": 0.0}
    for kind, item in bank.members:
        yield head | {"kind": kind, "item": item, "topics": bank.holders(kind, item)} | empty


def _merged(scenes: DataFrame, state: DataFrame | None, config: Config) -> DataFrame:
    """Scenes and, in front of each sequence, the rows of its state."""
    sets = [
        (F.coalesce(F.col(c), F.array()) if config.scorer in SIGNALS and c in scenes.columns else F.array()).cast("array<string>").alias(c)
        for c in ("tokens", "entities")
    ]
    none = F.lit(None).cast(f"struct<{STATE.replace(' ', ':').replace(',:', ',')}>").alias("_state")
    rows = scenes.select(
        "seq_id", F.lit(1).alias("_part"), F.col("pos").cast("bigint").alias("pos"),
        F.col("scene").cast("array<double>").alias("scene"), *sets, none,
    )
    if state is None:
        return rows
    heads = state.select(
        F.col("seq_id").cast(dict(scenes.dtypes)["seq_id"]).alias("seq_id"), F.lit(0).alias("_part"), F.lit(None).cast("bigint").alias("pos"),
        *[F.array().cast(t).alias(c) for c, t in (("scene", "array<double>"), ("tokens", "array<string>"), ("entities", "array<string>"))],
        F.struct(*STATE_COLUMNS).alias("_state"),
    )
    return rows.unionByName(heads)


def _sequences(batches: Iterator[pa.RecordBatch], config: Config, ended):
    """Advance one bank per sequence; yields ``key, pos, topic, changed``, and calls ``ended(key, bank, next_pos)``."""
    nobody = object()
    key, bank, next_pos = nobody, None, 0
    for batch in batches:
        keys, parts = batch.column("seq_id").to_pylist(), np.array(batch.column("_part").to_pylist())
        x = matrix(batch.filter(pa.array(parts == 1)).column("scene"))
        places, at = batch.column("pos").to_pylist(), 0
        for i in range(len(keys)):
            if keys[i] != key:
                if bank is not None:
                    yield from ended(key, bank, next_pos)
                key, bank, next_pos = keys[i], None, 0
            if parts[i] == 0:
                row = batch.column("_state")[i].as_py()
                bank = bank or bank_of(config, len(row["mean"]))
                put_state(bank, row)
                next_pos = row["next_pos"]
                continue
            bank = bank or bank_of(config, x.shape[1])
            tokens, entities = (frozenset(batch.column(c)[i].as_py()) for c in ("tokens", "entities"))
            topic, changed = bank.assign(x[at : at + 1], tokens, entities)
            at += 1
            if places[i] is not None:
                next_pos = max(next_pos, places[i] + 1)
            yield keys[i], places[i], int(topic[0]), bool(changed[0])
    if bank is not None:
        yield from ended(key, bank, next_pos)


def resume(scenes: DataFrame, state: DataFrame | None, config: Config = Config()) -> DataFrame:
    """``seq_id, pos, topic, is_boundary`` of ``scenes``, where each sequence goes on from its ``state``."""
    kind = dict(scenes.dtypes)["seq_id"]

    def run(batches):
        key_type, out = None, []

        def watched():
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("seq_id").type
                yield batch

        def done():
            columns = list(zip(*out))
            types = (key_type, pa.int64(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["seq_id", "pos", "topic", "is_boundary"]
            )

        for row in _sequences(watched(), config, lambda *_: ()):
            out.append(row)
            if len(out) == OUT_ROWS:
                yield done()
                out = []
        if out:
            yield done()

    rows = in_order(_merged(scenes, state, config), "_part", "pos")
    return stream(rows, run, f"seq_id {kind}, pos bigint, topic int, is_boundary boolean")


def handed_over(scenes: DataFrame, config: Config = Config(), state: DataFrame | None = None) -> DataFrame:
    """The state table after ``scenes``, for a later :func:`resume` or stream."""
    kind = dict(scenes.dtypes)["seq_id"]

    def run(batches):
        key_type = None

        def watched():
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("seq_id").type
                yield batch

        def done(out):
            arrays = [pa.array([k for k, _ in out], key_type)]
            arrays += [pa.array([r[c] for _, r in out], t) for c, t in _ARROW.items()]
            return pa.RecordBatch.from_arrays(arrays, names=["seq_id", *_ARROW])

        ended = lambda key, bank, next_pos: ((key, row) for row in state_rows(bank, next_pos))
        out = []
        for row in _sequences(watched(), config, ended):
            if len(row) == 2:
                out.append(row)
            if len(out) == OUT_ROWS:
                yield done(out)
                out = []
        if out:
            yield done(out)

    rows = in_order(_merged(scenes, state, config), "_part", "pos")
    return stream(rows, run, f"seq_id {kind}, {STATE}")
