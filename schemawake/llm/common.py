"""What the operators share: reading tables, scratch tables in the shared folder, dealing rows out evenly."""

from __future__ import annotations

import ctypes
import math
import resource
import sys
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, saved, shared_dir  # noqa: F401

#: Shuffle files go when the query that wrote them ends; every step here ends in a written table, so none is read again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows in an Arrow batch: whole texts of a few kB each, so a worker holds a few MB at a time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; also sets the session's Arrow batches to BATCH_ROWS rows and has shuffle files removed with their query."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set(_CLEAN, "true")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents in a range that is sorted in one task, about.
RANGE_ROWS = 65_536


def in_ranges(rows: DataFrame, n_rows: int, order: list, then: str) -> DataFrame:
    """rows dealt by ranges of `order` into tasks of about RANGE_ROWS rows (at least the session's shuffle partitions) and sorted there, by `then` too: task i holds what comes before task i + 1.

    `order` should be short values, as the driver gets a sample of them; rows equal in it may be split over tasks.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / RANGE_ROWS))
    return rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order, then)


#: MB of its own that a worker may keep between steps; below that, getting pages anew costs more than they are worth.
HELD_MB = 240


def own_mb() -> float:
    """MB that this process has by itself (no mapped files)."""
    with open("/proc/self/statm") as f:
        _, resident, mapped, *_ = map(int, f.read().split())
    return (resident - mapped) * resource.getpagesize() / (1 << 20)


def give_back() -> None:
    """In a worker that holds more than HELD_MB, memory that is free goes back to the system: workers stay for all of a session's queries, and what they keep counts beside the JVM's heap."""
    import pyarrow as pa

    if not sys.platform.startswith("linux") or own_mb() <= HELD_MB:
        return
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def lean(run: Callable, *args: Any) -> Any:
    """run(*args), with free memory given back before it and after it."""
    give_back()
    out = run(*args)
    give_back()
    return out


def text_of(col: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(col), F.lit(""))


def map_texts(docs: DataFrame, keep: list[str], run: Callable[[list[str]], dict], schema: str) -> DataFrame:
    """docs' `keep` columns, passed through as they are, with the columns that run(texts) makes for each Arrow batch of whole texts (null: empty)."""
    import pyarrow as pa

    columns = [*keep, *(f.split()[0] for f in schema.split(", "))]
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    target = _arrow_types(schema)

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = run([t or "" for t in part.column(len(keep)).to_pylist()])
            cols = [*(part.column(i) for i in range(len(keep))), *(x if isinstance(x, pa.Array) else pa.array(x, target[k]) for k, x in made.items())]
            yield pa.RecordBatch.from_arrays(cols, columns)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(each, f"{kinds}, {schema}" if kinds else schema)


def _arrow_types(schema: str) -> dict:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<float>": pa.list_(pa.float32())}
    return {k: kinds[t] for k, t in (f.split() for f in schema.split(", "))}
