"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}
_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a new temporary one only where that is unset and all tasks run in this process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; it goes with the session."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def sweep() -> int:
    """Deletes the scratch tables and folders of this process that are still there, and tells how many; results that read them are lost. Runs at exit."""
    gone = 0
    for path, spark in list(_left.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, path)
            gone += 1
        del _left[path]
    return gone


atexit.register(sweep)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder, in a folder for each value of `by`, and read back: its lineage ends there, so a lost executor costs one file read."""
    spark = df.sparkSession
    path = folder(spark, name)
    _write(df, path, codec, by)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def _write(df: DataFrame, path: str, codec: str, by: str | None = None) -> None:
    conf, write = df.sparkSession.conf, df.write.mode("append").option("compression", codec)
    as_was = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        (write.partitionBy(by) if by else write).parquet(path)
    finally:
        conf.unset(_CLEAN) if as_was is None else conf.set(_CLEAN, as_was)


def saved_in_rounds(tables: list[DataFrame], keys: list[str], rounds: int, make: Callable[..., DataFrame], name: str, codec: str = "zstd") -> DataFrame:
    """saved(make(*tables)), where make works on each value of `keys` by itself: round by round on the rows of a part of the values, so that only these are in shuffle files at once."""
    path = folder(tables[0].sparkSession, name)
    for i in range(rounds):
        made = make(*(df.where(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == i) for df in tables))
        _write(made, path, codec)
    back = made.sparkSession.read.schema(made.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables written by `saved` that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if at := getattr(df, "scratch_path", None):
            _delete(df.sparkSession, at)
            _left.pop(at, None)
