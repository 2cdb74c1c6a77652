"""Topic assignment as a stateful stream: the state of a sequence lives across micro-batches.

Any split of the input into micro-batches gives the assignments of the batch operator, for every scorer. Rows
that arrive before their predecessors wait in state. With ``gap_seconds`` a timer closes a gap while the
stream runs: all rows that wait by then are assigned in order. Without it they wait until the input has
ended, when ``unfinished`` assigns them, as the batch operator does. Rows whose position was already passed or is null have no
place; they are counted, left out, and kept in state for ``passed_rows``.

``hand_over`` reads the state of a stopped stream as a table from which a batch run (``resume``) or another stream goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from eventide.operators.resume import STATE_COLUMNS, TOPIC_COLUMNS, resume
from eventide.operators.segment import SIGNALS, Config, bank_of

#: Grouping by a null mixes groups up in Python, so a sequence is keyed by its id, or any value, and whether the id is null.
KEY = ("__id", "__none")
OUTPUT = "seq_id {key}, pos bigint, topic int, is_boundary boolean, late bigint"
TOPIC = "n double, mu array<double>, m2 array<double>, last array<double>, n_tok double, n_ent double"
#: Rows that are returned together when a timer closes a gap.
OUT_ROWS = 1000


class _Open:
    """One sequence while a micro-batch works on it: its bank, read from the state and written back.

    All topics are read, each with its tokens and entities, since each of them competes for a scene; only topics
    that changed are written back. A topic's items are one value: every access to the state is a call to the
    JVM, and one for each item would take far longer than the assignment.
    """

    def __init__(self, store: "TopicProcessor", dim: int):
        self.store, self.bank = store, bank_of(store.config, dim)
        self.next_pos = self.late = self.waiting = self.due = 0
        self.topics = set()
        if store.head.exists():
            prev, self.next_pos, self.late, self.waiting, self.due, used, seen, mean = store.head.get()
            self.bank.put_head(used, prev, seen, np.asarray(mean, dtype=float))
            for k in range(used):
                self.bank.put_topic(k, *store.topics.getValue((k,)))
                if store.signals:
                    for kind, items in zip("te", store.sets.getValue((k,))):
                        self.bank.put_items(kind, k, items)

    def take(self, scene, tokens, entities):
        """Assign the scene at the next position."""
        topic, changed = self.bank.assign(np.asarray(scene, dtype=float)[None, :], frozenset(tokens), frozenset(entities))
        self.topics.add(int(topic[0]))
        place, self.next_pos = self.next_pos, self.next_pos + 1
        return place, int(topic[0]), bool(changed[0])

    def take_waiting(self):
        """Assign the row that waits at the next position, if there is one."""
        at = (self.next_pos,)
        if not self.waiting or not self.store.waiting.containsKey(at):
            return None
        row = self.take(*self.store.waiting.getValue(at))
        self.store.waiting.removeKey(at)
        self.waiting -= 1
        return row

    def save(self) -> None:
        bank, store = self.bank, self.store
        for k in self.topics:
            store.topics.updateValue((k,), tuple(bank.topic(k).values()))
            if store.signals:
                store.sets.updateValue((k,), (bank.items("t", k), bank.items("e", k)))
        store.head.update((
            int(bank.prev[0]), self.next_pos, self.late, self.waiting, self.due, int(bank.used[0]), float(bank.seen[0]),
            bank.mean[0].tolist(),
        ))


class TopicProcessor(StatefulProcessor):
    """State of one sequence: a head record, its topics, their tokens, and rows that came too early."""

    def __init__(self, config: Config, gap_seconds: float | None = None):
        self.config, self.signals = config, config.scorer in SIGNALS
        self.gap = None if gap_seconds is None else int(gap_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState(
            "head",
            "prev int, next_pos bigint, late bigint, n_waiting bigint, due bigint, used int, seen double, mean array<double>",
        )
        self.topics = handle.getMapState("topics", "topic int", TOPIC)
        self.sets = handle.getMapState("sets", "topic int", "tokens array<string>, entities array<string>")
        self.waiting = handle.getMapState(
            "waiting", "pos bigint", "scene array<double>, tokens array<string>, entities array<string>"
        )
        self.passed = handle.getListState("passed", "pos bigint, scene array<double>")

    def _frame(self, key, rows: list, late: int) -> pd.DataFrame:
        done = pd.DataFrame(rows, columns=["pos", "topic", "is_boundary"])
        done.insert(0, "seq_id", pd.Series([None if key[1] else key[0]] * len(done), dtype=object if key[1] else None))
        return done.assign(late=late)

    def _set_timer(self, state: _Open, moved: bool, now: int) -> None:
        """A timer runs from the moment since which the next position is missing."""
        if self.gap is None or (state.due and state.waiting and not moved):
            return
        if state.due:
            self.handle.deleteTimer(state.due)
        state.due = now + self.gap if state.waiting else 0
        if state.due:
            self.handle.registerTimer(state.due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, moved = None, False
        for chunk in rows:
            chunk = chunk.sort_values("pos", kind="stable", na_position="last")
            out, passed = [], []
            for pos, *row in zip(chunk["pos"].tolist(), *[chunk[c].tolist() for c in ("scene", "tokens", "entities")]):
                scene, tokens, entities = (list(v) for v in row)
                if state is None:
                    state = _Open(self, len(scene))
                if pd.isna(pos) or pos < state.next_pos:
                    passed.append((None if pd.isna(pos) else int(pos), scene))
                elif pos > state.next_pos:
                    if state.waiting and self.waiting.containsKey((int(pos),)):
                        passed.append((int(pos), scene))
                    else:
                        self.waiting.updateValue((int(pos),), (scene, tokens, entities))
                        state.waiting += 1
                else:
                    row = state.take(scene, tokens, entities)
                    while row is not None:
                        out.append(row)
                        row = state.take_waiting()
            if passed:
                self.passed.appendList(passed)
                state.late += len(passed)
            if out:
                moved = True
                yield self._frame(key, out, state.late)
        if state is not None:
            self._set_timer(state, moved, timerValues.getCurrentProcessingTimeInMs())
            state.save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Give up the missing positions and assign what waits behind them, in order."""
        places = sorted(p for (p,) in list(self.waiting.keys()))
        if not places:
            return
        state, out = _Open(self, len(self.waiting.getValue((places[0],))[0])), []
        for place in places:
            state.next_pos = place
            out.append(state.take_waiting())
            if len(out) == OUT_ROWS:
                yield self._frame(key, out, state.late)
                out = []
        if out:
            yield self._frame(key, out, state.late)
        state.due = 0
        state.save()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        sets: dict[int, dict[str, list]] = {}
        for row in initialState.to_dict("records"):
            self.head.update((
                int(row["prev"]), int(row["next_pos"]), 0, 0, 0, int(row["used"]), float(row["seen"]), list(row["mean"])
            ))
            if row["kind"] == "topic":
                value = [row[c] if np.isscalar(row[c]) else list(row[c]) for c in TOPIC_COLUMNS]
                self.topics.updateValue((int(row["topics"][0]),), tuple(value))
                if self.signals:
                    sets.setdefault(int(row["topics"][0]), {"t": [], "e": []})
            else:
                for k in row["topics"]:
                    sets.setdefault(int(k), {"t": [], "e": []})[row["kind"]].append(row["item"])
        for k, items in sets.items():
            # The rows of a sequence may come in several frames.
            before = self.sets.getValue((k,)) if self.sets.containsKey((k,)) else ([], [])
            self.sets.updateValue((k,), (list(before[0]) + items["t"], list(before[1]) + items["e"]))

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """State outside the heap, with changelog checkpoints in the query's folder."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _keyed(rows: DataFrame, *columns) -> DataFrame:
    kind = dict(rows.dtypes)["seq_id"]
    return rows.select(F.coalesce("seq_id", F.lit(0).cast(kind)).alias(KEY[0]), F.isnull("seq_id").alias(KEY[1]), *columns)


def segment_stream(
    scenes: DataFrame, config: Config = Config(), gap_seconds: float | None = None, start: DataFrame | None = None
) -> DataFrame:
    """``seq_id, pos, topic, is_boundary, late`` for a stream of ``seq_id, pos, scene`` (and, for ``signals``, ``tokens, entities``).

    ``gap_seconds`` is how long a missing position holds back the rows behind it (None: until the input ends; a closed
    gap makes its rows late). ``start`` is a state table of an earlier run: positions go on from there.
    """
    use_state_store(scenes.sparkSession)
    sets = [
        (F.coalesce(F.col(c), F.array()) if config.scorer in SIGNALS and c in scenes.columns else F.array()).cast("array<string>").alias(c)
        for c in ("tokens", "entities")
    ]
    kind = dict(scenes.dtypes)["seq_id"]
    rows = _keyed(scenes, F.col("pos").cast("bigint").alias("pos"), F.col("scene").cast("array<double>").alias("scene"), *sets)
    known = None
    if start is not None:
        known = _keyed(start.withColumn("seq_id", F.col("seq_id").cast(kind)), *STATE_COLUMNS).groupBy(*KEY)
    return rows.groupBy(*KEY).transformWithStateInPandas(
        TopicProcessor(config, gap_seconds), OUTPUT.format(key=kind), "Append",
        "None" if gap_seconds is None else "ProcessingTime", initialState=known,
    )


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def _unkeyed() -> list:
    return [F.when(~F.col(KEY[1]), F.col(KEY[0])).alias("seq_id")]


def hand_over(spark: SparkSession, checkpoint: str, only: DataFrame | None = None) -> DataFrame:
    """State table of a stopped stream (or of the sequences whose keys are in ``only``), without the rows that wait or were passed."""
    state = lambda name: _state(spark, checkpoint, name) if only is None else _state(spark, checkpoint, name).select(
        "*", *[F.col(f"key.{c}").alias(c) for c in KEY]
    ).join(only, [*KEY], "left_semi").drop(*KEY)
    head = state("head").select("key.*", "value.*").where("used > 0")
    topics = state("topics").select(
        "key.*", F.lit("topic").alias("kind"), F.lit("").alias("item"), F.array("user_map_key.topic").alias("topics"), "user_map_value.*"
    )
    empty = [F.array().cast("array<double>").alias(c) if c in ("mu", "m2", "last") else F.lit(0.0).alias(c) for c in TOPIC_COLUMNS]
    held = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(f"user_map_value.{c}").alias("items")) for kind, c in (("t", "tokens"), ("e", "entities"))
    ])
    kinds = state("sets").select("key.*", "user_map_key.topic", F.explode(held).alias("h"))
    pairs = kinds.select(*KEY, "topic", "h.kind", F.explode("h.items").alias("item"))
    members = pairs.groupBy(*KEY, "kind", "item").agg(F.array_sort(F.collect_list("topic")).alias("topics")).select(
        *KEY, "kind", "item", "topics", *empty
    )
    rows = topics.unionByName(members).join(head, [*KEY])
    return rows.select(*_unkeyed(), *STATE_COLUMNS)


def unfinished(spark: SparkSession, checkpoint: str, config: Config = Config()) -> DataFrame:
    """``seq_id, pos, topic, is_boundary`` of the rows that still wait when the input has ended and the stream has stopped."""
    waiting = _state(spark, checkpoint, "waiting").select("key.*", "user_map_key.pos", "user_map_value.*")
    rows = waiting.select(*_unkeyed(), "pos", "scene", "tokens", "entities")
    return resume(rows, hand_over(spark, checkpoint, waiting.select(*KEY).distinct()), config)


def passed_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``seq_id, pos, scene`` of the rows that came late, again, or without a position."""
    rows = _state(spark, checkpoint, "passed").select("key.*", "list_element.*")
    return rows.select(*_unkeyed(), "pos", "scene")


def append_turns(assigned: DataFrame, path: str, checkpoint: str, buckets: int = 256, **trigger) -> StreamingQuery:
    """Append turns with their topic to the long-term table, in folders by sequence bucket."""
    bucket = F.pmod(F.xxhash64("seq_id"), F.lit(buckets))
    return (
        assigned.withColumn("bucket", bucket)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .partitionBy("bucket")
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
