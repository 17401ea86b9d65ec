"""Intermediate tables in the folder that driver and executors share.

A session's tables lie in one folder with a lease, a small file that every new table renews. The folder goes when the
session's JVM ends (or at ``release``); a folder whose session was killed goes when its lease has not been renewed for
``STALE_DAYS`` and another session begins to write.
"""

from __future__ import annotations

import os
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's option that deletes a query's shuffle files when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where written intermediate tables go on a single machine whose session names no shared folder.
LOCAL_FALLBACK = os.path.join("/tmp", "checkpoints", "edgewright")
#: Folders of sessions, their leases, and for how long a lease may rest.
SESSION, LEASE, STALE_DAYS = "ew-session-", "_lease", 7.0

_folders: dict[tuple[str, str], str] = {}


def _at(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def base_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local-mode session may leave that setting unset; a cluster without it is an
    error, because a machine-local folder would lose rows."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{LOCAL_FALLBACK}"


def session_dir(spark: SparkSession) -> str:
    """The session's folder, made and registered for deletion when it is first asked for; its lease is renewed."""
    base, app = base_dir(spark), spark.sparkContext.applicationId
    folder = _folders.get((base, app))
    if folder is None:
        sweep(spark)
        folder = _folders[(base, app)] = f"{base}/{SESSION}{app}-{uuid.uuid4().hex[:8]}"
        fs, where = _at(spark, folder)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    fs, lease = _at(spark, f"{folder}/{LEASE}")
    fs.create(lease, True).close()
    return folder


def release(spark: SparkSession) -> None:
    """Delete all tables that the session has written; for its end, as nothing can read them then."""
    folder = _folders.pop((base_dir(spark), spark.sparkContext.applicationId), None)
    if folder is not None:
        fs, where = _at(spark, folder)
        fs.delete(where, True)


def sweep(spark: SparkSession, days: float = STALE_DAYS) -> int:
    """Delete the folders of sessions whose lease is older than that; how many went. A folder without a lease has just
    been made or is not ours, and stays."""
    fs, base = _at(spark, base_dir(spark))
    if not fs.exists(base):
        return 0
    gone = 0
    for found in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base, f"{SESSION}*/{LEASE}")) or ():
        if found.getModificationTime() < (time.time() - days * 86_400) * 1000:
            gone += bool(fs.delete(found.getPath().getParent(), True))
    return gone


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the session's, which driver and executors share."""
    return f"{session_dir(spark)}/ew-{uuid.uuid4().hex}"


@contextmanager
def option(spark: SparkSession, key: str, value: str):
    """A session option that holds for a while and is then what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, or to a folder of the caller's, and read it back: lineage ends in files that
    outlive any executor. The shuffle files of the plan that made it go when it is written."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    with option(spark, FREE_SHUFFLES, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and that no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/ew-" in folder:
            fs, path = _at(df.sparkSession, folder)
            fs.delete(path.getParent(), True)
