"""Helpers shared by the corpus operators: input tables, words, and written intermediate tables."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word ends at the space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only for a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="eventide-llm-"))
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and its size is known.

    The optimizer sees the size of the files, so that a later join broadcasts the table only while
    it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Sent:
    """A broadcast object whose class travels with it, so that workers need no copy of the package. Its size must be bounded by a parameter.

    A worker unpacks it once and keeps it from task to task, for as long as Spark keeps the broadcast there.
    """

    def __init__(self, spark: SparkSession, thing):
        self._raw = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    @property
    def value(self):
        if not hasattr(self._raw, "_thing"):
            self._raw._thing = pickle.loads(self._raw.value)
        return self._raw._thing

    def unpersist(self) -> None:
        self._raw.unpersist()


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none.

    Splitting is cheaper than matching. Only the first and the last piece can be empty.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL meets NULL; the keys come from the left side."""
    other = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def slices(batches, rows: int = 1000):
    """The record batches in parts of at most ``rows`` rows, so that what is derived from a part stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


@contextmanager
def small_batches(spark: SparkSession, size: int, rows: int) -> Iterator[None]:
    """Jobs that run inside hand Python workers Arrow batches of about ``size`` bytes and read Parquet files ``rows`` rows at a time.

    Spark's own bounds (64 MB and 10,000 rows, 4,096 rows of a file) hold for each task; long lists reach them. The session's settings come back at the end,
    so a table must be written inside.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": f"{size}b", "spark.sql.parquet.columnarReaderBatchSize": str(rows)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, name: str, open_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeat ``step`` until ``open_rows`` of the state is empty, at most ``rounds`` times; each state is written."""
    for _ in range(rounds):
        if open_rows(state).isEmpty():
            break
        state = written(step(state), name)
    return state
