"""Version watermarks, source priority, commit after success, duplicate suppression and throttling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Order of dispatch; the first two only once a preview exists.
PRIORITY = ("desktop", "lib", "android")
EVERY_SECONDS = 3.0
#: After so long a value may be told again.
KEEP_SECONDS = 86_400.0
_MICROS = "micros_"  # names with a line in front would be replaced


def new_versions(versions: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Versions above their source's watermark; those of the last source in PRIORITY also when forced. versions: source, code, force; watermarks: source, last_code."""
    j = versions.join(watermarks, "source", "left")
    return j.where((F.col("code") > F.coalesce("last_code", F.lit(0))) | (F.coalesce("force", F.lit(False)) & (F.col("source") == PRIORITY[-1])))


def dispatched(candidates: DataFrame, batch: str, preview: str) -> DataFrame:
    """One version per batch: the source of highest priority; those that need a preview wait until the flag column `preview` is true."""
    order = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source"))
    ready = candidates.where(F.col(preview) | (F.col("source") == PRIORITY[-1]))
    w = Window.partitionBy(batch).orderBy(order, F.desc("code"))
    return ready.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def advanced(watermarks: DataFrame, seen: DataFrame) -> DataFrame:
    """Watermarks after `seen` (source, code) has been processed; they never go back."""
    both = watermarks.select("source", F.col("last_code").alias("code")).unionByName(seen.select("source", "code"))
    return both.groupBy("source").agg(F.max("code").alias("last_code"))


def without_repeats(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from the key's row before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def throttled(events: DataFrame, key: str, order: list[str], seconds: float = EVERY_SECONDS) -> DataFrame:
    """Rows at least `seconds` after the key's last row that was let through, in the order of the columns `order`, the first of which is the time.

    A key's rows pass through one task in order, which remembers only the last time, however many rows the key has; it goes from each row let
    through straight to the next by bisection.
    """
    at = [events.columns.index(key), events.columns.index(order[0])]
    wait = np.timedelta64(round(seconds * 1e6), "us")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, when = None, None
        for pdf in frames:
            keys, times = pdf.iloc[:, at[0]].to_numpy(), pdf.iloc[:, at[1]].to_numpy("datetime64[us]")
            keep = np.zeros(len(pdf), bool)
            bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(pdf)]
            for a, b in zip(bounds, bounds[1:]):
                i = a
                if when is not None and keys[a] == last:
                    i += int(np.searchsorted(times[a:b], when + wait))
                while i < b:
                    keep[i], last, when = True, keys[i], times[i]
                    i += max(1, int(np.searchsorted(times[i:b], when + wait)))
            yield pdf[keep]

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, events.schema)


class _Gate:
    """Lets a key's rows (value, microseconds) through: the first one, one whose last let through is `keep` seconds old, and one of another value at least `seconds` after it."""

    def __init__(self, seconds: float, keep: float, last: tuple | None = None) -> None:
        self.seconds, self.keep, self.last = seconds, keep, last

    def __call__(self, value, at) -> bool:
        age = None if self.last is None else (at - self.last[1]) / 1e6
        if age is None or age >= self.keep or (value != self.last[0] and age >= self.seconds):
            self.last = (value, at)
            return True
        return False


def throttled_values(events: DataFrame, key: str, value: str, order: list[str], seconds: float = EVERY_SECONDS, keep: float = KEEP_SECONDS) -> DataFrame:
    """throttled() with repeats of the last value let through left out, too, until it is `keep` seconds old; `order` starts with the time."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, gate = object(), None
        for pdf in frames:
            passed = []
            times = pdf[order[0]].to_numpy("datetime64[us]").astype(np.int64).tolist()
            for k, v, t in zip(pdf[key], pdf[value], times, strict=True):
                if gate is None or k != own:
                    own, gate = k, _Gate(seconds, keep)
                passed.append(gate(v, t))
            yield pdf[passed]

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, events.schema)


class _Throttle(StatefulProcessor):
    def __init__(self, value: str, order: list[str], columns: list[str], kind: str, seconds: float, keep: float) -> None:
        self.value, self.order, self.columns, self.kind, self.seconds, self.keep = value, order, columns, kind, seconds, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("last", f"value {self.kind}, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order)
        gate = _Gate(self.seconds, self.keep, tuple(self.state.get()) if self.state.exists() else None)
        yield pdf.loc[[gate(v, t) for v, t in zip(pdf[self.value], pdf[_MICROS].tolist(), strict=True)], self.columns]
        self.state.update(gate.last)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(math.ceil(gate.last[1] / 1000 + self.keep * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttled_stream(events: DataFrame, key: str, time: str, value: str, seconds: float = EVERY_SECONDS, keep: float = KEEP_SECONDS, late: str = "0 seconds", then: tuple[str, ...] = ()) -> DataFrame:
    """throttled_values() for a stream. State is each key's last value and time let through, in the RocksDB store; an event-time timer ends it
    once the watermark (`late` behind the latest row) is `keep` seconds past it, so what is kept are the keys of that long, not all there ever were.

    Whether a row passes depends on its own time and not on when the timer has fired, so any division into batches gives the same rows, as long as none
    is late. A key's rows of one batch are sorted by time and the columns `then` in memory.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    how = _Throttle(value, [_MICROS, *then], events.columns, dict(events.dtypes)[value], seconds, keep)
    rows = events.withWatermark(time, late).withColumn(_MICROS, F.unix_micros(time))
    return rows.groupBy(key).transformWithStateInPandas(how, events.schema, "Append", "EventTime")


def announcements(latest: DataFrame, announced: DataFrame) -> DataFrame:
    """Releases above the last announced one of their source; silent on a source's first run."""
    j = latest.join(announced.withColumnRenamed("layer", "last"), "source")
    return j.where((F.col("last") > 0) & (F.col("layer") > F.col("last"))).drop("last")


def ingest(stream: DataFrame, process: Callable[[DataFrame, int], None], commit: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs what has arrived to its end; every batch is processed first and its watermark committed after, so a failure repeats it. Both must be idempotent by batch."""

    def each(batch: DataFrame, number: int) -> None:
        process(batch, number)
        commit(batch, number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_new(stream: DataFrame, process: Callable[[DataFrame, int], None], marks: str, checkpoint: str) -> None:
    """ingest() of what lies above each source's watermark (stream: source, code and others). The watermarks are rows (source, last_code) below the path `marks`, the highest of a source counts; they go up after each batch, so what is delivered again is left out."""
    spark = stream.sparkSession

    def above(batch: DataFrame) -> DataFrame:
        known = spark.read.schema("source string, last_code long").parquet(marks).groupBy("source").agg(F.max("last_code").alias("last_code"))
        return batch.join(known, "source", "left").where(F.col("code") > F.coalesce("last_code", F.lit(0))).drop("last_code")

    def commit(batch: DataFrame, number: int) -> None:
        batch.groupBy("source").agg(F.max("code").cast("long").alias("last_code")).write.mode("append").parquet(marks)

    ingest(stream, lambda batch, number: process(above(batch), number), commit, checkpoint)
