"""Operator 8, mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, are cut into blocks of
BLOCK_CHARS characters (a document belongs to the block in which it starts). With
weight w, block i of a source is released at slot floor(i / w) and due at slot
ceil((i + 1) / w); every slot goes to the released block that is due first.
Before any slot t, a source has therefore had between w * t - 1 and w * t + 1
blocks, both excluded.

Weights are exact fractions, and so are releases and deadlines, so the bound holds
for the target weights themselves at any length. The driver goes through the slots
once and keeps the sources' blocks so far at the start of every RANGE slots; tasks
go through each range again and write its slots. When a source runs out, a new
phase begins in which the others share its place in proportion; `mixed` tells the
rows before that point, where all the target weights hold. Every document has its
place once: nothing is dropped or repeated.

Cases: a null text counts one character, as an empty one; a null source is a
source of its own; repeated rows have a place each; an empty table gives no rows;
a source without a weight in `weights` is an error; one of weight 0 comes when the
others have run out. The driver's work grows with the slots and with the square of
the number of sources, as each source's end is a phase.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

BLOCK_CHARS = 1 << 14
#: Slots that a task works out, and the parts of a schedule that repeats (for weights in whole parts).
RANGE = 1 << 16
PERIOD = 1000
#: Default target: shares in proportion to size ** TEMPER.
TEMPER = 0.5


def shares(weights: dict, period: int) -> dict:
    """Whole parts of the period, at least one each, by largest remainders."""
    total = sum(weights.values())
    exact = {s: Fraction(w) * period / Fraction(total) for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (parts[s] - exact[s], str(s)))
    while (gap := period - sum(parts.values())) != 0:
        for s in order if gap > 0 else sorted((s for s in parts if parts[s] > 1), key=lambda s: (exact[s] - parts[s], str(s))):
            if not gap:
                break
            parts[s] += 1 if gap > 0 else -1
            gap += -1 if gap > 0 else 1
    return parts


def period_slots(parts: dict) -> dict:
    """Earliest deadline first over one period: per source, the slots of its blocks."""
    period = sum(parts.values())
    jobs = sorted((j * period // q, -(-(j + 1) * period // q), str(s), s) for s, q in parts.items() for j in range(q))
    slots: dict = {s: [] for s in parts}
    ready: list = []
    at = 0
    for t in range(period):
        while at < len(jobs) and jobs[at][0] <= t:
            heapq.heappush(ready, (jobs[at][1], jobs[at][2], at))
            at += 1
        slots[jobs[heapq.heappop(ready)[2]][3]].append(t)
    return slots


def exact_shares(weights: dict) -> tuple[dict, int]:
    """Whole numbers in the exact proportions of the weights above 0 (of all alike, if none is), and their sum."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0} or dict.fromkeys(weights, Fraction(1))
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: x // common for s, x in whole.items()}, sum(whole.values()) // common


def earliest_deadline(parts: list[int], period: int, done: list[int], start: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, index of the source, block, release, deadline) from slot `start` on, when each source has had `done` blocks."""
    job = lambda k, i: (-(-(i + 1) * period // parts[k]), k, i, i * period // parts[k])
    ready: list = []
    waiting = [(job(k, i)[3], job(k, i)) for k, i in enumerate(done)]
    heapq.heapify(waiting)
    t = start
    while True:
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1])
        deadline, k, i, release = heapq.heappop(ready)
        yield t, k, i, release, deadline
        after = job(k, i + 1)
        heapq.heappush(waiting, (after[3], after))
        t += 1


def ranges(blocks: dict, weights: dict, size: int = RANGE) -> Iterator[tuple]:
    """(phase, first slot of the phase, first and end slot within it, period, sources, their parts, their blocks before the phase and within it before the range)."""
    left, before, base, phase = dict(blocks), dict.fromkeys(blocks, 0), 0, 0
    while left:
        parts, period = exact_shares({s: weights[s] for s in left})
        names = sorted(parts, key=lambda s: (s is None, str(s)))
        whole, had, first = [parts[s] for s in names], [0] * len(names), 0
        ends = [left[s] for s in names]
        row = lambda a, b, state: (phase, base, a, b, str(period), names, [str(x) for x in whole], [before[s] for s in names], state)  # noqa: E731, B023
        state = list(had)
        for t, k, *_ in earliest_deadline(whole, period, had[:], 0):
            had[k] += 1
            if had[k] == ends[k] or t + 1 - first == size:
                yield row(first, t + 1, state)
                first, state = t + 1, list(had)
            if had[k] == ends[k]:
                break
        for s, n in zip(names, had, strict=True):
            before[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        base, phase = base + t + 1, phase + 1


def _slots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for r in part.to_pylist():
            whole, period = [int(x) for x in r["parts"]], int(r["period"])
            out: list[tuple] = []
            for t, k, i, release, deadline in earliest_deadline(whole, period, r["had"], r["first"]):
                if t == r["end"]:
                    break
                out.append((r["sources"][k], r["before"][k] + i, r["base"] + t, r["phase"], whole[k] / period, r["base"] + release, r["base"] + deadline))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["_source", "_block", "slot", "phase", "share", "release", "deadline"])


_RANGES = "phase int, base long, first long, end long, period string, sources array<string>, parts array<string>, before array<long>, had array<long>"


def slots(spark, blocks: dict, weights: dict, size: int = RANGE) -> DataFrame:
    """_source, _block, slot, phase, share, release and deadline of every block, worked out range by range in tasks."""
    rows = list(ranges(blocks, weights, size))
    return spark.createDataFrame(rows, _RANGES).repartition(max(1, min(len(rows), 4096))).mapInArrow(_slots, "_source string, _block long, slot long, phase int, share double, release long, deadline long")


def place(docs: DataFrame, weights: dict | None = None, block_chars: int = BLOCK_CHARS, temper: float = TEMPER) -> DataFrame:
    """docs with a struct column `_mix` of block, slot, start, phase, share, release, deadline and mixed. Order by slot, then start, to read the mix.

    The rows are numbered in parts of each source (12 bits of the hash that orders them), so a source of any size is spread over tasks.
    """
    spark = docs.sparkSession
    h = F.xxhash64("doc_id", "text")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").cast("string").alias("_source"), (F.char_length(text_of()) + 1).cast("long").alias("_n"), h.alias("_h"), F.shiftrightunsigned(h, 52).alias("_part"))
    return _placed(spark, rows, docs, weights, block_chars, temper)


def _placed(spark, rows: DataFrame, docs: DataFrame, weights: dict | None, block_chars: int, temper: float) -> DataFrame:
    sizes = rows.groupBy("_source", "_part").agg(F.sum("_n").alias("_size"))
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("n")).collect()  # a row per source
    total = {r["_source"]: r["n"] for r in totals}
    if weights is not None and (missing := set(total) - set(weights)):
        raise ValueError(f"sources without a weight: {sorted(map(str, missing))}")
    target = {s: weights[s] if weights is not None else n**temper for s, n in total.items()}
    blocks = slots(spark, {s: -(-n // block_chars) for s, n in total.items()}, target)
    before = F.sum("_size").over(Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("_source"), F.col("_part"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("_source", "_part").orderBy("_h", "_n", F.col("_row.doc_id")).rowsBetween(Window.unboundedPreceding, -1))
    at = rows.withColumn("_within", F.coalesce(within, F.lit(0)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_source", "_part")]
    at = at.alias("a").join(starts.alias("b"), same[0] & same[1]).select("a.*", (F.col("_before") + F.col("_within")).alias("_start"))
    at = at.withColumn("_block", F.floor(F.col("_start") / block_chars).cast("long"))
    # a long document may leave blocks after its first without a start
    at = at.alias("a").join(blocks.alias("s"), F.col("a._source").eqNullSafe(F.col("s._source")) & (F.col("a._block") == F.col("s._block")))
    mix = F.struct(F.col("a._block").alias("block"), "slot", F.col("_start").alias("start"), "phase", "share", "release", "deadline", (F.col("phase") == 0).alias("mixed"))
    return at.select("_row", mix.alias("_mix"))


def mix_documents(docs: DataFrame, weights: dict | None = None, block_chars: int = BLOCK_CHARS, temper: float = TEMPER) -> DataFrame:
    """doc_id, source and the place of every document: only these and the text's length are shuffled."""
    thin = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("_h"), (F.char_length(text_of()) + 1).cast("long").alias("_n"))
    rows = thin.select(F.struct("doc_id", "source").alias("_row"), F.col("source").cast("string").alias("_source"), "_n", "_h", F.shiftrightunsigned("_h", 52).alias("_part"))
    return _placed(docs.sparkSession, rows, docs, weights, block_chars, temper).select("_row.doc_id", "_row.source", "_mix.*")


def in_mixed_order(docs: DataFrame, weights: dict | None = None, block_chars: int = BLOCK_CHARS, temper: float = TEMPER) -> DataFrame:
    """All documents with their columns, dealt into files by slot and sorted in the mixed order."""
    return place(docs, weights, block_chars, temper).repartitionByRange(F.col("_mix.slot"), F.col("_mix.start")).sortWithinPartitions("_mix.slot", "_mix.start").select("_row.*")
