"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SQL_SETTINGS = {
    # Timestamps are instants; every comparison and format is done in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lookups with a hot key on the probe side (copies of one text, replies to one
    # message, postings of one term) are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators rely on to an existing session."""
    for key, value in _SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "16g") -> SparkSession:
    """A session for tests and single-machine trials."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("deskloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back
    to a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="deskloom-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


_scratch: list[str] = []
_scope = threading.local()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/deskloom/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    getattr(_scope, "paths", []).append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> int:
    hadoop, cleared = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        cleared += bool(path.getFileSystem(hadoop).delete(path, True))
    return cleared


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes what this thread writes below the shared folder inside the block, at its end.

    For work that ends with a stored result, as a micro-batch does.
    """
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        paths, _scope.paths = _scope.paths, outer if outer is not None else []
        _delete(spark, paths)
        for path in paths:
            _scratch.remove(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``materialize`` of what ``make`` returns; the tables that it wrote on the way are deleted.

    For a result of several steps that nothing else reads the steps of.
    """
    path = scratch_path(spark, label)
    with scratch_scope(spark):
        df = make()
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process has written below the shared folder; the number of paths.

    For the end of a run: results that are still read from these tables must be written first.
    """
    paths = _scratch[:]
    _scratch.clear()
    return _delete(spark, paths)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Used where a result feeds several later stages or a loop. The table outlives any
    executor, keeps columns prunable, and gives the optimizer real sizes, so a small
    result is broadcast only because its size is known.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over the cluster when a scan has fewer splits than there are cores.

    One small Parquet file is one task, whatever the work per row. A large table has more
    splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
