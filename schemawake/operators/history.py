"""Release history: which ids left, what is new, which snapshot is the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def removed_ids(released: DataFrame) -> DataFrame:
    """Ids that were in a layer, are missing from the next one and from the newest. released: layer, id."""
    rows = released.select("layer", "id").distinct()
    # one row per layer, so the window without partitions is small
    steps = rows.select("layer").distinct().select("layer", F.lead("layer").over(Window.orderBy("layer")).alias("next"))
    held = rows.join(F.broadcast(steps.where("next is not null")), "layer")
    gone = held.alias("a").join(rows.alias("b"), (F.col("a.next") == F.col("b.layer")) & (F.col("a.id") == F.col("b.id")), "left_anti")
    newest = rows.join(F.broadcast(rows.agg(F.max("layer").alias("layer"))), "layer").select("id")
    return gone.select("id").distinct().join(newest, "id", "left_anti")


def removed_ids_except(released: DataFrame) -> DataFrame:
    """The same: all ids but those of the newest layer."""
    rows = released.select("layer", "id")
    newest = rows.join(F.broadcast(rows.agg(F.max("layer").alias("layer"))), "layer").select("id")
    return rows.select("id").subtract(newest)


def release_catalog(released: DataFrame, known: int) -> DataFrame:
    """layer, ids, first_run, backfill: layers from the last known one on, that one included, if there is a newer one."""
    per = released.groupBy("layer").agg(F.count_distinct("id").alias("ids"))
    top = released.agg(F.coalesce(F.max("layer"), F.lit(0)).alias("latest"), (F.count("*") > 0).alias("any"))
    return per.crossJoin(F.broadcast(top)).select("layer", "ids", "latest", F.lit(known == 0).alias("first_run"), (F.col("any") & (F.lit(known) < F.col("latest")) & (F.col("layer") >= known)).alias("backfill"))


def trim_recent(layers: DataFrame, keep: int, scope: list[str]) -> DataFrame:
    """The latest `keep` rows by time, then layer."""
    w = Window.partitionBy(*scope).orderBy(F.desc("created_at"), F.desc("layer"))
    return layers.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def rotate_roles(snapshots: DataFrame, recent: DataFrame, scope: list[str]) -> DataFrame:
    """On promotion the incoming snapshot becomes preview; the old preview becomes stable if the scope has more than one recent layer, the rest lose their role.

    snapshots: scope, id, role (stable, preview, incoming or null).
    """
    many = recent.groupBy(*scope).agg(F.count("*").alias("recent"))
    j = snapshots.join(many, scope, "left")
    several = F.coalesce("recent", F.lit(0)) > 1
    role = F.when(F.col("role") == "incoming", "preview").when((F.col("role") == "preview") & several, "stable").when((F.col("role") == "stable") & ~several, "stable")
    return j.withColumn("role", role).drop("recent")


def pick_baseline(heads: DataFrame, recent: DataFrame, scope: list[str]) -> DataFrame:
    """The stable snapshot if the layer was seen recently and there is one, else the preview. heads: scope, layer, stable, preview."""
    seen = recent.select(*scope, "layer").distinct().withColumn("seen", F.lit(True))
    j = heads.join(seen, [*scope, "layer"], "left")
    return j.select(*scope, "layer", F.when(F.col("seen") & F.col("stable").isNotNull(), F.col("stable")).otherwise(F.col("preview")).alias("baseline"))
