"""Queries that read files of each shape, written from the driver tables first, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import declarations as D
from ..operators import classes, parse, state
from ..scratch import folder
from ..sources import readers as R
from . import bindings as B

_ONE = "one AS (SELECT 1 AS x)"


def split_lines(spark, sf_dir):
    """The declaration lines as text files, a folder each, read in splits and numbered by a prefix scan."""
    path = folder(spark, "texts")
    B.decl_lines(spark, sf_dir).repartition("file").sortWithinPartitions("file", "line").select("file", "source").write.partitionBy("file").text(path)
    lines = R.numbered_lines(spark, path).withColumn("file", F.regexp_extract("file", "file=([^/]+)/", 1))
    return parse.with_section(lines).select("file", "line", "source", "kind")


#: Objects of a dump: ids are signed text, some have a layer, some a flag of their own.
_DUMP = "objs AS (SELECT p_size AS dump, p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'method' ELSE 'constructor' END AS kind, CAST(p_partkey * 7 - 3000 AS VARCHAR(20)) AS id, replace(p_name, ' ', '.') || p_partkey AS name, p_type AS result, CASE WHEN p_partkey % 5 = 0 THEN 7 END AS layer, p_partkey % 9 = 0 AS force_secret FROM part)"


def _dump(spark, sf_dir):
    rows = B.load(spark, sf_dir, _DUMP, "SELECT * FROM objs")
    params = F.array(F.struct(F.lit("a").alias("name"), F.lit("int").alias("type")), F.struct(F.lit("b").alias("name"), F.col("result").alias("type")))
    one = lambda kind, name: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("k", "id", "name", params.alias("params"), "result", "layer", "force_secret")))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias(name), x["params"].alias("params"), x["result"].alias("type"), x["layer"].alias("layer"), x["force_secret"].alias("force_secret")))
    return rows.groupBy("dump").agg(one("constructor", "predicate").alias("constructors"), one("method", "method").alias("methods"))


def dump_read(spark, sf_dir):
    """JSON dumps, read with the secret flag forced."""
    path = folder(spark, "dumps")
    _dump(spark, sf_dir).repartition("dump").write.partitionBy("dump").json(path)
    return R.read_dump(spark, path).select("kind", "name", "id", F.trim(D.params_text(F.col("params"))).alias("params"), "result", "layer", "force_secret")


def releases_read(spark, sf_dir):
    """Release lists by layer, replaced in part by a second delivery; ids that are there twice count once."""
    path, out = folder(spark, "releases"), folder(spark, "released")
    rows = B.load(spark, sf_dir, B.RELEASED, "SELECT layer, CAST(id * 91 - 40000 AS VARCHAR(20)) AS id, id % 3 = 0 AS method FROM released")
    ids = lambda when: F.collect_list(F.when(when, F.struct("id")))
    rows.groupBy("layer").agg(ids(~F.col("method")).alias("constructors"), ids(F.col("method")).alias("methods")).repartition("layer").write.partitionBy("layer").json(path)
    released = R.read_releases(spark, path)
    state.replace_release(released, out)
    state.replace_release(released.where("layer % 2 = 0 and kind = 'method'"), out)
    return spark.read.parquet(out).select(F.col("layer").cast("int").alias("layer"), "kind", "id")


_LINKED = "linked AS (SELECT DISTINCT o_custkey % 40 AS page_id, CAST(year(o_orderdate) AS INT) AS layer FROM orders WHERE o_custkey % 40 < CAST(year(o_orderdate) AS INT) - 1990 OR o_custkey % 40 > 5)"


def release_pages(spark, sf_dir):
    rows = B.load(spark, sf_dir, _LINKED, "SELECT * FROM linked")
    links = F.transform(F.array_sort(F.collect_list("layer")), lambda x: F.concat(F.lit('<li><a href="?layer='), x.cast("string"), F.lit('">Layer</a></li>')))
    return R.layers_on_page(rows.groupBy("page_id").agg(F.array_join(links, "\n").alias("html"))).select("page_id", "pos", "layer", "latest")


_SOURCES = """texts AS (SELECT 'f' || s_suppkey AS file, CASE s_suppkey % 4 WHEN 0 THEN 'int AppVersion = ' || (s_suppkey * 1001) || ';' || chr(10) || 'str AppVersionStr = "' || (s_suppkey % 7) || '.' || (s_suppkey % 9) || '";' || chr(10) || 'constexpr int32 MTPROTO_LAYER = ' || (s_suppkey % 200) || ';'
    WHEN 1 THEN 'project(Other VERSION 9.9)' || chr(10) || 'project(TDLib VERSION 1.' || (s_suppkey % 50) || '.' || (s_suppkey % 3) || ' LANGUAGES CXX)' WHEN 2 THEN 'this.layer = ' || (s_suppkey % 90) || ';' ELSE s_name END AS text FROM supplier)"""


def source_versions(spark, sf_dir):
    """Version numbers in source files: written as files, read whole."""
    path = folder(spark, "sources")
    B.load(spark, sf_dir, _SOURCES, "SELECT file, text FROM texts").repartition("file").write.partitionBy("file").text(path)
    found = R.versions_of(R.whole_files(spark, path))
    return found.select(F.regexp_extract("file", "file=([^/]+)/", 1).alias("file"), "version_code", "version_name", "cmake_version", "layer")


def app_info(spark, sf_dir):
    path = folder(spark, "apps")
    rows = B.load(spark, sf_dir, _ONE, "SELECT s_suppkey AS k, s_suppkey || '.0' AS version, s_suppkey * 10 + s_suppkey % 10 AS version_code, 'https://example.org/' || s_suppkey AS file_url FROM supplier")
    rows.repartition("k").write.partitionBy("k").json(path)
    return R.read_app_info(spark, path)


def saved_state(spark, sf_dir):
    """One saved state as a document of nested maps, taken apart into its tables; the rows of all of them as (part, a, b, n, m)."""
    pins = B.load(spark, sf_dir, _ONE, "SELECT 'os' || (s_suppkey % 3) AS os, 'o' || s_suppkey AS name, CAST(s_suppkey - 50 AS VARCHAR(20)) AS old_constructor, CAST(s_suppkey + 7 AS VARCHAR(20)) AS new_constructor FROM supplier")
    by_os = pins.groupBy("os").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("old_constructor", "new_constructor")))).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("os", "m"))).alias("patched_objects"))
    rel = B.load(spark, sf_dir, B.RELEASED, "SELECT DISTINCT CAST(layer AS VARCHAR(9)) AS layer, CAST(id AS VARCHAR(20)) AS id FROM released WHERE id % 7 = 0")
    released = rel.groupBy("layer").agg(F.struct(F.collect_list(F.struct("id")).alias("constructors"), F.array(F.struct(F.lit("-1").alias("id"))).alias("methods")).alias("r")).agg(F.map_from_entries(F.collect_list(F.struct("layer", "r"))).alias("released_layers"))
    snap = _dump(spark, sf_dir).where("dump = 11").select(F.struct(F.lit(181).alias("layer"), F.struct("constructors", "methods").alias("main_api"), F.struct("constructors", "methods").alias("e2e_api")).alias("preview_layer"))
    marks = spark.range(1).select(F.lit(7).alias("last_version_code"), F.lit(8).alias("last_tdesk_id"), F.array(F.lit(3), F.lit(4)).alias("recent_layers"))
    # one row each, so these joins are on a constant of one row
    one = lambda df: df.withColumn("one", F.lit(1))
    doc = one(marks).join(one(by_os), "one").join(one(released), "one").join(one(snap), "one").drop("one")
    path = folder(spark, "state")
    doc.coalesce(1).write.json(path)
    t = R.tables_of_state(spark.read.schema(R.STATE).json(path))
    none, row = F.lit(None).cast("long"), lambda df, part, a, b, n, m: df.select(F.lit(part).alias("part"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), n.cast("long").alias("n"), m.cast("long").alias("m"))
    out = row(t["pins"], "pin", "os", "name", F.col("old_id"), F.col("new_id")).unionByName(row(t["released"], "released", "layer", "kind", F.col("id"), none))
    out = out.unionByName(row(t["recent_layers"].withColumn("x", F.lit("")), "recent", "layer", "x", none, none)).unionByName(row(t["watermarks"].withColumn("x", F.lit("")), "marks", "x", "x", F.col("last_version_code"), F.col("last_tdesk_id")))
    shots = t["snapshots"].withColumn("who", F.concat_ws("/", "role", "api", "kind"))
    return out.unionByName(row(shots, "snapshot", "who", "name", F.col("id"), F.col("force_secret").cast("int")))


#: Classes with a layer in their name (older ones than the snapshot's go), without an id, bare ones, and plain ones.
_LAYERED = "SELECT p_partkey AS k, 'TL_' || replace(p_name, ' ', '_') || '_q' || p_partkey || 'x' || CASE p_partkey % 5 WHEN 0 THEN '_layer' || (100 + p_partkey % 100) ELSE '' END AS class, CASE WHEN p_partkey % 5 <> 1 THEN p_partkey * 7 + 300 END AS id, p_type FROM part"


def objects_of_layers(spark, sf_dir):
    rows = B.load(spark, sf_dir, _ONE, _LAYERED)
    made = F.when(F.col("k") % 5 == 2, F.array(F.lit("serializeToStream"))).when(F.col("k") % 2 == 0, F.array(F.lit("readParams"), F.lit("serializeToStream"))).otherwise(F.array(F.lit("deserializeResponse")))
    none = F.array().cast("array<struct<name:string,type:string,nesting:int>>")
    table = rows.select(F.lit("TLRPC").alias("pkg"), "class", F.concat(F.lit("TL_"), F.lower("p_type")).alias("parent"), "id", made.alias("functions"), none.alias("fields"))
    return classes.objects_from_classes(table, 150).select("class", "kind", "id", "name", "name_layer")


#: Generics that are declared or not, what stands in brackets, the three ids that are let through, a name with a number of its own.
_GENERIC = """gen AS (SELECT 'f' || k AS file, 1 AS line, CASE k % 6 WHEN 0 THEN nm || '#6c50051c {{X:Type}} q:!X = X;' WHEN 1 THEN nm || '#24b524c5 {{X:Type}} {{X:Type}} q:!Y r:flags.1?X = X;' WHEN 2 THEN nm || '#6abd9782 n:# [ a:Unseen ] = Vector;'
    WHEN 3 THEN nm || '#6abd978 = Bool;' WHEN 4 THEN nm || 'x12#' || {hex} || ' = Bool;' ELSE nm || '#6ABD9782 {{X:Type}} {{Y:Type}} a:Vector<X> b:%Y = Vector<Y>;' END AS source, nm, k % 6 AS m FROM decl{more})"""

_SPARK_HEX, _DUCK_HEX = "lower(hex(crc32(nm || 'x = Bool')))", "lower(to_hex(" + B.duck_crc("(nm || 'x = Bool')") + "))"


def validate_generics(spark, sf_dir):
    lines = B.load(spark, sf_dir, f"{B.decl('spark')}, {_GENERIC.format(hex=_SPARK_HEX, more='')}", "SELECT file AS corpus, file, line, source FROM gen")
    return parse.problems(lines, ["corpus"]).select("file", "line", "rule", "reason", "fatal")


_FNS = (split_lines, dump_read, releases_read, release_pages, source_versions, app_info, saved_state, objects_of_layers, validate_generics)
QUERIES = {f.__name__: f for f in _FNS}

_U = lambda x: f"(CAST({x} AS BIGINT) & 4294967295)"
ORACLES = {
    "split_lines": "WITH " + B.lines("duckdb") + """, n AS (SELECT file, source, row_number() OVER (PARTITION BY file ORDER BY line) AS line FROM lines),
        m AS (SELECT *, coalesce(last_value(CASE source WHEN '---types---' THEN 'constructor' WHEN '---functions---' THEN 'method' END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line), 'constructor') AS kind FROM n) SELECT file, line, source, kind FROM m WHERE source <> '' AND NOT starts_with(source, '//') AND NOT starts_with(source, '---')""",
    "dump_read": f"WITH {_DUMP} SELECT kind, name, {_U('id')} AS id, 'a:int b:' || result AS params, result, coalesce(layer, 0) AS layer, TRUE AS force_secret FROM objs",
    "releases_read": f"WITH {B.RELEASED}, r AS (SELECT DISTINCT layer, CASE WHEN id % 3 = 0 THEN 'method' ELSE 'constructor' END AS kind, {_U('id * 91 - 40000')} AS id FROM released) SELECT * FROM r WHERE layer % 2 = 1 OR kind = 'method'",
    "release_pages": f"WITH {_LINKED}, n AS (SELECT page_id, layer, row_number() OVER (PARTITION BY page_id ORDER BY layer) - 1 AS pos FROM linked) SELECT page_id, pos::INT AS pos, layer, max(layer) OVER (PARTITION BY page_id) AS latest FROM n QUALIFY pos > 0",
    "source_versions": """SELECT 'f' || s_suppkey AS file, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 1001 END AS version_code, CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey % 7) || '.' || (s_suppkey % 9) END AS version_name, CASE WHEN s_suppkey % 4 = 1 THEN '1.' || (s_suppkey % 50) || '.' || (s_suppkey % 3) END AS cmake_version,
        CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey % 200)::INT WHEN 2 THEN (s_suppkey % 90)::INT END AS layer FROM supplier""",
    "app_info": "SELECT s_suppkey || '.0' AS version_name, s_suppkey AS version_code, 'https://example.org/' || s_suppkey AS file_url FROM supplier",
    "saved_state": f"""WITH {B.RELEASED}, {_DUMP} SELECT 'pin' AS part, 'os' || (s_suppkey % 3) AS a, 'o' || s_suppkey AS b, {_U('s_suppkey - 50')} AS n, s_suppkey + 7 AS m FROM supplier
        UNION ALL SELECT DISTINCT 'released', layer::VARCHAR, 'constructor', id, NULL::BIGINT FROM released WHERE id % 7 = 0 UNION ALL SELECT DISTINCT 'released', layer::VARCHAR, 'method', 4294967295, NULL::BIGINT FROM released WHERE id % 7 = 0
        UNION ALL SELECT 'recent', '3', '', NULL, NULL UNION ALL SELECT 'recent', '4', '', NULL, NULL UNION ALL SELECT 'marks', '', '', 7, 8
        UNION ALL SELECT 'snapshot', 'preview/main/' || kind, name, {_U('id')}, CASE WHEN force_secret THEN 1 ELSE 0 END FROM objs WHERE dump = 11 UNION ALL SELECT 'snapshot', 'preview/e2e/' || kind, name, {_U('id')}, 1 FROM objs WHERE dump = 11""",
    "objects_of_layers": f"""WITH c AS ({_LAYERED}) SELECT class, CASE WHEN k % 5 = 2 THEN 'bare' WHEN k % 2 = 0 THEN 'constructor' ELSE 'method' END AS kind, id, replace(split_part(substr(class, 4), '_q', 1), '_', '.') || '.q' || k || 'x' AS name, CASE WHEN k % 5 = 0 THEN 100 + k % 100 ELSE 0 END AS name_layer
        FROM c WHERE id IS NOT NULL AND (k % 5 <> 0 OR 100 + k % 100 >= 150) AND NOT (((id >> 24) & 255) = ((id >> 16) & 255) AND ((id >> 16) & 255) = ((id >> 8) & 255))""",
    "validate_generics": f"WITH {B.DUCK_CRC_TABLE}, {B.decl('duckdb')}, {_GENERIC.format(hex=_DUCK_HEX, more=', crc_table')}" + """
        SELECT file, line, 'V14' AS rule, 'nothing makes "Y", the type of parameter "q"' AS reason, FALSE AS fatal FROM gen WHERE m = 1 UNION ALL SELECT file, line, 'V12', 'no flag word "flags" stands before parameter "r"', TRUE FROM gen WHERE m = 1
        UNION ALL SELECT file, line, 'V15', 'id #6abd978 is not the checksum of ' || nm, FALSE FROM gen WHERE m = 3""",
}
