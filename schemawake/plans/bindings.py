"""Inputs of the queries, derived from the driver tables by SQL that both engines run.

`text(dialect)` gives a list of common table expressions; Spark runs them over the
Parquet tables, DuckDB over its views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()

#: CRC-32 for an engine without it: the table of 256 remainders by rule, then a fold over the bytes.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], [0,0,0,0,0,0,0,0]::UBIGINT[]), lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END))"


def duck_crc(text: str) -> str:
    """CRC-32 of a text expression; needs the table crc_table(t) in scope."""
    byte = f"('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::UBIGINT"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(0, octet_length(encode({text}))), lambda i: {byte})), lambda a, b: xor(a >> 8, crc_table.t[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT"


DUCK_CRC_TABLE = f"crc_table AS (SELECT {_CRC_TABLE} AS t)"


def decl(dialect: str) -> str:
    """decl: k, m, nm, res, ps (parameters), norm (checksum text), bit."""
    return """decl_base AS (
      SELECT p_partkey AS k, p_partkey % 23 AS m, replace(p_name, ' ', '_') || p_partkey AS nm, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS res, substr(p_brand, 7) AS bn, p_partkey % 34 AS bit FROM part),
    decl AS (
      SELECT k, m, nm, res, bit, ' flags:# size:flags.' || bit || '?int brand:' || CASE WHEN k % 5 = 0 THEN 'T' || bn ELSE 'Vector<' || res || '>' END AS ps,
        nm || ' flags:# size:flags.' || bit || '?int brand:' || CASE WHEN k % 5 = 0 THEN 'T' || bn ELSE 'Vector ' || res END || ' = ' || res AS norm FROM decl_base)"""


def lines(dialect: str) -> str:
    """lines: file, line, source; every validation rule fires somewhere."""
    head = (DUCK_CRC_TABLE + ", ") if dialect == "duckdb" else ""
    hex_ = f"lower(to_hex({duck_crc('norm')}))" if dialect == "duckdb" else "lower(hex(crc32(norm)))"
    table = ", crc_table" if dialect == "duckdb" else ""
    return (
        head
        + decl(dialect)
        + f""",
    with_id AS (SELECT decl.*, {hex_} AS id, ' = ' || res || ';' AS tail FROM decl{table}),
    lines AS (
      SELECT 'file' || CAST(floor(k / 100.0) AS BIGINT) AS file, k % 100 + 2 + CASE WHEN k % 100 >= 50 THEN 1 ELSE 0 END AS line,
        CASE m WHEN 1 THEN nm || '#' || id || ps || ' = ' || res
               WHEN 2 THEN nm || '#' || id || ps || ';'
               WHEN 3 THEN '= ' || res || ';'
               WHEN 4 THEN nm || ps || tail
               WHEN 5 THEN '1' || nm || '#' || id || ps || tail
               WHEN 6 THEN nm || '#xyz' || ps || tail
               WHEN 7 THEN nm || '#0' || ps || tail
               WHEN 8 THEN nm || '#' || id || ps || ' x:' || tail
               WHEN 9 THEN nm || '#dead01' || ps || tail
               WHEN 10 THEN 'same_name#' || id || ps || tail
               WHEN 11 THEN nm || '#' || id || ps || ' size:int' || tail
               WHEN 12 THEN nm || '#' || id || ps || ' a:flags2.1?int b:flags2.2?int flags2:#' || tail
               WHEN 13 THEN nm || '#' || id || ps || ' wide:flags.40?int' || tail
               WHEN 14 THEN nm || '#' || id || ps || ' bad:Missing' || tail
               WHEN 15 THEN nm || '#abc123' || ps || tail
               WHEN 16 THEN nm || '#' || id || ps || ' any:!Nope' || tail
               WHEN 22 THEN '// ' || nm ELSE nm || '#' || id || ps || tail END AS source FROM with_id
      UNION ALL SELECT DISTINCT 'file' || CAST(floor(k / 100.0) AS BIGINT), 1, '---types---' FROM decl
      UNION ALL SELECT DISTINCT 'file' || CAST(floor(k / 100.0) AS BIGINT), 52, '---functions---' FROM decl
      UNION ALL SELECT DISTINCT 'file' || CAST(floor(k / 100.0) AS BIGINT), 104, '' FROM decl)"""
    )


SNAP = """sold AS (
      SELECT CAST(year(l_shipdate) AS INT) AS version, l_partkey AS pk, 's' || l_suppkey AS pname, max(l_returnflag) AS ptype FROM lineitem GROUP BY 1, 2, 3),
    snap AS (
      SELECT DISTINCT version, CASE WHEN pk % 11 = 0 THEN 'e2e' ELSE 'main' END AS api, CASE WHEN pk % 3 = 0 THEN 'method' ELSE 'constructor' END AS kind,
        pk + CASE WHEN pk % 17 = 0 THEN 1000003 * (version - 1990) ELSE 0 END AS id,
        replace(p_name, ' ', '_') || pk AS name, 0 AS layer,
        'Brand' || substr(p_brand, 7) || CASE WHEN pk % 2 = 1 THEN '' ELSE '_' || (version % 2) END AS result, pk AS pos
      FROM sold JOIN part ON pk = p_partkey)"""

RELEASED = "released AS (SELECT CAST(year(o_orderdate) AS INT) AS layer, o_custkey AS id FROM orders)"

TREE = "tree AS (SELECT p_partkey AS class, CASE WHEN p_partkey > 0 THEN CAST(floor(p_partkey / 2.0) AS BIGINT) END AS parent, p_type AS member, p_brand AS value FROM part)"

VER = """ver AS (
      SELECT CASE event_type WHEN 'click' THEN 'android' ELSE event_type END AS source, CAST(event_id % 7 AS INT) AS major, (event_id % 7) || '.' || (event_id % 90) || '.' || (event_id % 50) || CASE WHEN event_id % 13 = 0 THEN 'b' ELSE '' END AS version_name, event_id AS code, event_id % 101 = 0 AS force FROM events),
    marks AS (SELECT source, max(CASE WHEN n = 80 THEN code END) AS last_code FROM (SELECT source, code, row_number() OVER (PARTITION BY source ORDER BY code) AS n FROM ver) AS x GROUP BY source)"""


def load(spark: SparkSession, sf_dir: str, ctes: str, select: str) -> DataFrame:
    """The result of `WITH ctes select` over the driver tables."""
    used = [t for t in TABLES if f" {t}" in ctes + select]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    text = f"WITH {ctes} {select}"
    for t in used:
        frames[t].createOrReplaceTempView(f"sw_{t}")
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 sw_{t}", text)
    return spark.sql(text)


def decl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, lines("spark"), "SELECT file, CAST(line AS INT) AS line, source FROM lines")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of SNAP with their params nested, in order of name: rows are dealt by part once; both groupings and the join are made where they lie."""
    sales = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.year("l_shipdate").alias("version"), F.col("l_partkey").alias("pk"), "l_suppkey", "l_returnflag")
    sold = sales.repartition("pk").groupBy("version", "pk", "l_suppkey").agg(F.max("l_returnflag").alias("type"))
    nested = sold.groupBy("version", "pk").agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"), "type"))).alias("params"))
    pk, version = F.col("pk"), F.col("version")
    brand = F.substr(F.col("p_brand"), F.lit(7))
    return nested.join(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pk"), "p_name", "p_brand"), "pk").select(
        "version", "params", F.when(pk % 11 == 0, "e2e").otherwise("main").alias("api"), F.when(pk % 3 == 0, "method").otherwise("constructor").alias("kind"),
        (pk + F.when(pk % 17 == 0, F.lit(1000003) * (version - 1990)).otherwise(0)).alias("id"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), pk.cast("string")).alias("name"), F.lit(0).alias("layer"),
        F.concat(F.lit("Brand"), brand, F.when(pk % 2 == 1, "").otherwise(F.concat(F.lit("_"), (version % 2).cast("string")))).alias("result"), pk.alias("pos"),
    )


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version: the years that have a snapshot of their own and of the year before; a few rows."""
    y = load(spark, sf_dir, "y AS (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS version FROM lineitem JOIN part ON l_partkey = p_partkey)", "SELECT version FROM y")
    return y.join(y.select((F.col("version") + 1).alias("version")), "version")
