"""Operator 9, sharding: rendezvous hashing of stable record keys over weighted shards. DataFrame functions only.

Each (key, shard) pair gets a uniform number u from the first 52 bits of
md5("key:shard") and the score -weight / ln(u); the record goes to the shard of
the highest score. A new shard takes a record only if its own score is the
highest, so records move into it alone, in proportion to its weight.

Slots are gapless from 0 in each shard: rows are numbered in small groups (shard
and three hex digits of the md5 of key and text's CRC), and the groups' sizes are
summed up per shard, so neither one task nor one shard ever numbers all its rows
at once, and rows of one key are spread too. The hashes are worked out once, into
a scratch table.

Cases: a null key has the text "null" as its key; equal keys go to one shard; an
empty table gives an empty result; further
columns of the input are ignored unless asked for with `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_of

#: 2 ** 52 equal steps fit a double exactly; half a step keeps u above 0.
_STEPS = float(1 << 52)


def score(key: Column, shard: int, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_STEPS)
    return F.lit(-float(weight)) / F.ln(u)


def best_shard(key: Column, weights: list[float], first: int = 0, best: Column | None = None) -> Column:
    """Struct of the highest score among the shards from `first` on, and `best` if given, and the shard's number made negative; of equal scores the lowest shard."""
    each = [F.struct(score(key, s, w).alias("score"), F.lit(-s).alias("minus")) for s, w in enumerate(weights) if s >= first]
    each += [] if best is None else [best]
    return F.greatest(*each) if len(each) > 1 else each[0]


def assign_shards(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record: key, size, text_crc32, shard, slot and, with `grown` weights, grown_shard."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = text_of().cast("binary")
    number = lambda c: (-c["minus"]).cast("int")
    rows = docs.select(F.col(key), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), best_shard(k, weights).alias("_best"), *keep)
    if grown and grown[: len(weights)] == weights:
        more = number(best_shard(k, grown, len(weights), F.col("_best")))
    else:
        more = number(best_shard(k, grown)) if grown else F.lit(None).cast("int")
    part = F.substring(F.md5(F.concat(k, F.lit(":"), F.col("text_crc32").cast("string")).cast("binary")), 1, 3)
    rows = saved(rows.select(F.col(key), "size", "text_crc32", part.alias("_part"), number(F.col("_best")).alias("shard"), more.alias("grown_shard"), *keep), "sharded")
    in_part = Window.partitionBy("shard", "_part").orderBy(key, "size", "text_crc32")
    sizes = rows.groupBy("shard", "_part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return (
        rows.withColumn("_at", F.row_number().over(in_part) - 1)
        .join(starts, ["shard", "_part"])
        .withColumn("slot", (F.col("_start") + F.col("_at")).cast("long"))
        .drop("_part", "_start", "_at")
    )
