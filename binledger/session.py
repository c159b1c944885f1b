"""Session settings this library expects, and the shared folder for cut points."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("binledger")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and work tables, as the cluster names it.

    ``spark.checkpoint.dir`` is used where set. Only a local master may fall back
    to a temporary folder: on a cluster executors could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="binledger-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Makes a statement remove its shuffle files when it ends; otherwise they stay until the driver collects garbage.
_REMOVES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_guard = threading.Lock()
_inside: dict[int, list] = {}  # session -> how many are inside, setting before


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Statements begun inside remove their shuffle files when they end. Several threads may be inside."""
    session = spark._jsparkSession.hashCode()
    with _guard:
        held = _inside.setdefault(session, [0, spark.conf.get(_REMOVES, "false")])
        held[0] += 1
        spark.conf.set(_REMOVES, "true")
    try:
        yield
    finally:
        with _guard:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(_REMOVES, _inside.pop(session)[1])


def put(df, label: str = "step") -> str:
    """Write ``df`` as a table in the shared folder; returns its folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a work table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remove_cut(df) -> None:
    """Remove the tables that ``df``, made of nothing but tables from ``cut``, reads."""
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        remove(df.sparkSession, folder)


def cut(df, label: str = "step"):
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage to recompute, survives lost executors, and later
    steps read only the columns they need.
    """
    return df.sparkSession.read.schema(df.schema).parquet(put(df, label))
