"""Tables in, tables out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, scan_id: str | list[str] | None = None) -> DataFrame:
    """A table of raw pages; a scan filter prunes partitions and row groups."""
    pages = spark.read.parquet(path)
    if scan_id is None:
        return pages
    wanted = [scan_id] if isinstance(scan_id, str) else scan_id
    return pages.where(F.col("scan_id").isin(*wanted))


#: Splits that each core gets of a table to be parsed, so that no core waits for one long split at the end.
SPLITS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """Give a table that arrives in few splits several even ones per core.

    Parsing is row-local, so a single small file would keep one core busy, and a few large files all cores but not for
    the same time. Tables with enough splits pass through untouched.
    """
    wanted = SPLITS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


#: Tables of the sink itself: the scans of each run, and the runs that count in the order in which they were committed.
RUNS, COMMITS = "runs", "commits"
_COMMIT = "number bigint, run string"


def write_run(tables: dict[str, DataFrame], scans: DataFrame, folder: str, key: str = "scan_id") -> None:
    """Store the tables of one run; for every scan in ``scans`` they replace whatever earlier runs stored.

    ``scans`` are all scans of the run, those without pages, too: a scan of which a table has no row now has none there.
    Each table gets a folder for the run, with files of even size sorted by scan (no folder per scan; a large scan is
    spread over files). The run counts once its commit, one file with one row, stands: readers see all of a run or
    nothing. A run that ends before leaves files that nobody reads. The later commit counts, not the later clock.
    """
    spark, root, run = scans.sparkSession, folder.rstrip("/"), uuid.uuid4().hex
    for name, rows in {**tables, RUNS: scans.select(key).distinct()}.items():
        rows.hint("rebalance", key).sortWithinPartitions(key).write.mode("errorifexists").parquet(f"{root}/{name}/run={run}")
    # Only the row is made here, as one partition: it appears by the rename of its one file.
    last = commits(spark, folder).agg(F.coalesce(F.max("number"), F.lit(0).cast("bigint")).alias("number")).first().number
    row = spark.range(1).select(F.lit(last + 1).cast("bigint").alias("number"), F.lit(run).alias("run"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/{COMMITS}")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(number, run) of the runs that count; none in a folder without any."""
    path = f"{folder.rstrip('/')}/{COMMITS}"
    return spark.read.schema(_COMMIT).parquet(path) if _exists(spark, path) else spark.createDataFrame([], _COMMIT)


def current_runs(spark: SparkSession, folder: str, key: str = "scan_id") -> DataFrame:
    """Each scan with its last run, scans without any row included."""
    listed = spark.read.parquet(f"{folder.rstrip('/')}/{RUNS}").join(commits(spark, folder), "run")
    return listed.groupBy(key).agg(F.max(F.struct("number", "run")).alias("last")).select(key, F.col("last.run").alias("run"))


def read_current(spark: SparkSession, folder: str, name: str, key: str = "scan_id") -> DataFrame:
    """A stored table with the rows of each scan's last run."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}").join(current_runs(spark, folder, key), [key, "run"]).drop("run")


def compact(spark: SparkSession, folder: str, names: list[str], key: str = "scan_id") -> None:
    """Write the current rows of all scans as one new run, after which earlier runs hold nothing that counts."""
    scans = current_runs(spark, folder, key).select(key)
    write_run({name: read_current(spark, folder, name, key) for name in names}, scans, folder, key)


def remove_old_runs(spark: SparkSession, folder: str, names: list[str], key: str = "scan_id") -> int:
    """Delete the folders of committed runs that hold no scan's current rows; how many runs that were.

    For a time when nobody reads: a reader that began before would miss its files. Runs not committed yet stay.
    """
    gone = commits(spark, folder).select("run").join(current_runs(spark, folder, key).select("run").distinct(), "run", "left_anti")
    runs = [r.run for r in gone.toLocalIterator()]
    for run in runs:
        for name in [*names, RUNS]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}/run={run}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(runs)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)
