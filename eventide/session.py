"""Session helpers: settings that the operators rely on, and where checkpoints go."""

from __future__ import annotations

import importlib
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship_package() -> None:
    """Send the functions of this package to Python workers by value.

    Workers then need no copy of the package. That also holds for the worker that a stateful
    stream starts on the driver, which does not see ``--py-files``.
    """
    package = importlib.import_module("eventide")
    if package.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("eventide")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    ship_package()
    return builder.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of the cluster; a local one only where none is named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="eventide-checkpoint-")
    context.setCheckpointDir(folder)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be small, for use inside tasks.

    Reads at most ``limit + 1`` rows, and refuses a larger table instead of pulling it
    through the driver.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows
