"""Files to tables. Schemas are fixed; whole files are one row only where their text has to be searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import to_unsigned
from ..operators.parse import parse_lenient, section_mark
from ..scratch import saved

_PARAM = "array<struct<name:string,type:string>>"
_OBJECT = "struct<id:string,{name}:string,params:" + _PARAM + ",type:string,layer:int,force_secret:boolean>"
DUMP = f"constructors array<{_OBJECT.format(name='predicate')}>, methods array<{_OBJECT.format(name='method')}>"
_LISTS = f"constructors:array<{_OBJECT.format(name='predicate')}>,methods:array<{_OBJECT.format(name='method')}>"
_SNAPSHOT = f"struct<layer:int,main_api:struct<{_LISTS}>,e2e_api:struct<{_LISTS}>>"
RELEASE = "constructors array<struct<id:string>>, methods array<struct<id:string>>"
STATE = (
    "last_version_code bigint, last_tdesk_id bigint, last_tdlib_id bigint, last_corefork_layer bigint, message_id bigint, recent_layers array<int>, "
    "patched_objects map<string,map<string,struct<old_constructor:string,new_constructor:string>>>, "
    f"released_layers map<string,struct<constructors:array<struct<id:string>>,methods:array<struct<id:string>>>>, "
    f"stable_layer {_SNAPSHOT}, preview_layer {_SNAPSHOT}"
)
#: Fixed patterns of version numbers in source files.
HEADER_VERSION, HEADER_NAME = r"AppVersion *?= *?([0-9]+);", r'AppVersionStr *?= *?"([0-9.]+)";'
CMAKE_PROJECT, CMAKE_VERSION, LAYER_CONSTANT, LAYER_FIELD = "TDLib", r"project\({}\s+VERSION\s+([0-9.]+)", r"constexpr int32 MTPROTO_LAYER = ([0-9]+);", r"this\.layer = ([0-9]+);"
RELEASE_LINK = r'<li><a href="\?layer=([0-9]+)">'


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), source and kind of text files of any size, read in splits.

    A prefix scan in two levels: each split counts its lines and notes its last section mark; one row a split, added up over the
    splits before it, tells where its numbers begin and which section it begins in. Within a split the order that it was read in is
    kept, so no task holds more than a split and no window goes over a file.
    """
    own = F.monotonically_increasing_id()  # rising within a split, as a split is read by one task from its start
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), own.alias("at"), F.trim(F.col("value"), F.lit(" \t\r")).alias("source"))
    raw = saved(raw.withColumn("mark", section_mark(F.col("source"))), "split-lines")
    splits = raw.groupBy("file", "split").agg(F.count("*").alias("lines"), F.min("at").alias("first"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("at"))).alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("ahead"), F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit("constructor")).alias("opened"))
    so_far = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = raw.withColumn("kind", F.last("mark", ignorenulls=True).over(so_far)).join(splits, ["file", "split"])
    return rows.select("file", (F.col("at") - F.col("first") + F.col("ahead") + 1).alias("line"), "source", F.coalesce("kind", "opened").alias("kind"))


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    return parse_lenient(numbered_lines(spark, path))


def _ids(c: Column) -> Column:
    return to_unsigned(c.cast("bigint"))


def objects_of_dump(dump: DataFrame, secret: bool = False, keep: list[str] | None = None) -> DataFrame:
    """kind, name, id, params, result, layer, force_secret, pos of a dump's two arrays, and its columns `keep`; `secret` forces the flag."""

    def one(array: str, name: str, kind: str) -> DataFrame:
        rows = dump.select(*(keep or ()), F.posexplode(array).alias("pos", "o"))
        flag = F.lit(True) if secret else F.coalesce("o.force_secret", F.lit(False))
        return rows.select(*(keep or ()), F.lit(kind).alias("kind"), F.col(f"o.{name}").alias("name"), _ids(F.col("o.id")).alias("id"), "o.params", F.col("o.type").alias("result"), F.coalesce("o.layer", F.lit(0)).alias("layer"), flag.alias("force_secret"), "pos")

    return one("constructors", "predicate", "constructor").unionByName(one("methods", "method", "method"))


def read_dump(spark: SparkSession, path: str, secret: bool = True) -> DataFrame:
    return objects_of_dump(spark.read.schema(DUMP).json(path, multiLine=True), secret)


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """layer (from the folder name layer=N), kind, id."""
    raw = spark.read.schema(RELEASE + ", layer int").json(path, multiLine=True)
    one = lambda a, kind: raw.select("layer", F.lit(kind).alias("kind"), F.explode(a).alias("o")).select("layer", "kind", _ids(F.col("o.id")).alias("id"))
    return one("constructors", "constructor").unionByName(one("methods", "method"))


def layers_on_page(pages: DataFrame) -> DataFrame:
    """page_id, pos, layer, latest: release numbers linked on a page but the first; the last one is the latest. A page with one or none gives no rows."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(RELEASE_LINK), F.lit(1))).alias("pos", "layer")).where("pos > 0")
    last = rows.groupBy("page_id").agg(F.max_by(F.col("layer").cast("int"), "pos").alias("latest"))
    return rows.select("page_id", "pos", F.col("layer").cast("int")).join(last, "page_id")


def versions_of(files: DataFrame, project: str = CMAKE_PROJECT) -> DataFrame:
    """file, version_code, version_name, cmake_version (of that project), layer found in source files; null where a file has none."""
    found = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return files.select("file", found(HEADER_VERSION).cast("long").alias("version_code"), found(HEADER_NAME).alias("version_name"), found(CMAKE_VERSION.format(project)).alias("cmake_version"), F.coalesce(found(LAYER_CONSTANT), found(LAYER_FIELD)).cast("int").alias("layer"))


def read_app_info(spark: SparkSession, path: str) -> DataFrame:
    """version_name, version_code (the build number without its last digit), file_url."""
    raw = spark.read.schema("version string, version_code bigint, file_url string").json(path, multiLine=True)
    return raw.select(F.col("version").alias("version_name"), F.floor(F.col("version_code") / 10).cast("long").alias("version_code"), "file_url")


def tables_of_state(state: DataFrame) -> dict[str, DataFrame]:
    """watermarks, recent_layers, pins, released and snapshots (role, layer, api, kind and what objects_of_dump has) of a saved state (nested maps)."""
    pins = state.select(F.explode("patched_objects").alias("os", "m")).select("os", F.explode("m").alias("name", "p"))
    rel = state.select(F.explode("released_layers").alias("layer", "r")).withColumn("layer", F.col("layer").cast("int"))
    one = lambda a, kind: rel.select("layer", F.lit(kind).alias("kind"), F.explode(f"r.{a}").alias("o")).select("layer", "kind", _ids(F.col("o.id")).alias("id"))
    snaps = None
    for role in ("stable", "preview"):
        for api in ("main", "e2e"):
            held = state.where(f"{role}_layer is not null").select(F.col(f"{role}_layer.layer").alias("snapshot_layer"), f"{role}_layer.{api}_api.*")
            objects = objects_of_dump(held, api == "e2e", ["snapshot_layer"]).select(F.lit(role).alias("role"), "snapshot_layer", F.lit(api).alias("api"), "kind", "name", "id", "params", "result", "layer", "force_secret", "pos")
            snaps = objects if snaps is None else snaps.unionByName(objects)
    return {
        "snapshots": snaps,
        "watermarks": state.select("last_version_code", "last_tdesk_id", "last_tdlib_id", "last_corefork_layer"),
        "recent_layers": state.select(F.explode("recent_layers").alias("layer")),
        "pins": pins.select("os", "name", _ids(F.col("p.old_constructor")).alias("old_id"), _ids(F.col("p.new_constructor")).alias("new_id")),
        "released": one("constructors", "constructor").unionByName(one("methods", "method")),
    }
