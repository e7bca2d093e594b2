"""Session defaults and stage tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the job's own settings are used."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagequarry")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """The shared folder for stage tables: the cluster's checkpoint folder if it names one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="pagequarry-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet under the stage folder and read it back.

    The files outlive lost executors, cut the lineage, and let every later reader
    prune columns, which a row-based checkpoint cannot.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark).rstrip('/')}/pagequarry-stages/{label}-{uuid.uuid4().hex}"
    for scope in _open_scopes:
        scope.paths.append(path)
    with _shuffle_files_deleted(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether Spark deletes a query's shuffle files when it ends, instead of when the driver's collector finds them unused.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffle_files_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that begin in the body leave no shuffle files: a table that is written needs them no longer."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)


class StageTables:
    """The stage tables written while a scope is open."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def drop(self, spark: SparkSession) -> None:
        """Delete the tables; for a time when nothing that reads them will run again."""
        for path in self.paths:
            found = spark._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
        self.paths.clear()


_open_scopes: list[StageTables] = []


@contextmanager
def stage_tables() -> Iterator[StageTables]:
    """Notes the stage tables that the body writes."""
    scope = StageTables()
    _open_scopes.append(scope)
    try:
        yield scope
    finally:
        _open_scopes.remove(scope)


def settle(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``build`` gives, written once; the stage tables that it wrote on its way are deleted after that."""
    with stage_tables() as made:
        rows = build()
    out = materialize(rows, label)
    made.drop(rows.sparkSession)
    return out
