"""Queries over declaration lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import declarations as D
from ..functions import ids as I
from ..operators import parse
from . import bindings as B


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_strict(B.decl_lines(spark, sf_dir))


def idl_parse(spark, sf_dir):
    rows = parse.parse_lenient(B.decl_lines(spark, sf_dir))
    return rows.select("file", "line", "kind", "name", "id_hex", F.trim(D.params_text(F.col("params"))).alias("params"), "result")


def validate_syntax(spark, sf_dir):
    return parse.syntax_problems(_parsed(spark, sf_dir)).select("file", "line", "rule", "reason", "fatal")


def validate_dups(spark, sf_dir):
    return parse.duplicate_problems(_parsed(spark, sf_dir)).select("file", "line", "rule", "reason", "fatal")


def validate_params(spark, sf_dir):
    return parse.param_problems(_parsed(spark, sf_dir)).select("file", "line", "rule", "reason", "fatal")


def validate_types(spark, sf_dir):
    return parse.type_problems(_parsed(spark, sf_dir)).select("file", "line", "rule", "reason", "fatal")


def validate_ids(spark, sf_dir):
    return parse.id_problems(_parsed(spark, sf_dir)).select("file", "line", "rule", "reason", "fatal")


def validate_summary(spark, sf_dir):
    return parse.problem_totals(parse.problems(B.decl_lines(spark, sf_dir)))


def problems_shown(spark, sf_dir):
    """The first ten problems of every file."""
    return parse.shown_problems(parse.problems(B.decl_lines(spark, sf_dir))).select("file", "place", "line", "rule", "reason", "fatal")


def id_roundtrip(spark, sf_dir):
    k = "SELECT l_orderkey, l_linenumber, l_orderkey * 71549 + l_partkey * 31 AS v, CASE WHEN l_linenumber = 3 THEN 'abc' ELSE CAST(-(l_orderkey * 65537 + l_partkey) AS VARCHAR(30)) END AS s FROM lineitem"
    rows = B.load(spark, sf_dir, "one AS (SELECT 1 AS x)", k)
    hex_ = I.signed_text_to_hex(F.col("s"))
    u = I.to_unsigned(F.col("v"))
    return rows.select("l_orderkey", "l_linenumber", hex_.alias("hex_id"), I.hex_to_signed(hex_).alias("signed_id"), u.alias("unsigned_id"), I.to_signed(u).alias("back"), I.bit_of_mask(F.col("l_orderkey")).alias("bit"), I.is_placeholder(u).alias("placeholder"))


def decl_checksum(spark, sf_dir):
    rows = B.load(spark, sf_dir, B.decl("spark"), "SELECT k, nm, res, ps FROM decl")
    params = F.transform(F.split(F.trim("ps"), " "), lambda x: F.struct(F.substring_index(x, ":", 1).alias("name"), F.substr(x, F.instr(x, ":") + 1).alias("type")))
    text = D.declaration_text(F.col("nm"), params, F.col("res"))
    id_ = D.checksum_id(text)
    return rows.select("k", text.alias("declaration"), id_.alias("id"), D.declaration_line(F.col("nm"), id_, params, F.col("res")).alias("line"))


_LINES = "WITH " + B.lines("duckdb")
_SECTION = """,
    marked AS (SELECT *, coalesce(last_value(CASE source WHEN '---types---' THEN 'constructor' WHEN '---functions---' THEN 'method' END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line), 'constructor') AS kind FROM lines),
    body_lines AS (SELECT * FROM marked WHERE source <> '' AND NOT starts_with(source, '//') AND source NOT IN ('---types---', '---functions---'))"""
_STRICT = (
    _SECTION
    + r""",
    p0 AS (SELECT *, trim(regexp_replace(source, ';$', '')) AS body FROM body_lines),
    p1 AS (SELECT *, trim(regexp_extract(body, '=([^=]*)$', 1)) AS result, list_filter(regexp_split_to_array(trim(regexp_replace(body, '=[^=]*$', '')), '\s+'), lambda x: x <> '') AS fields FROM p0),
    p2 AS (SELECT *, coalesce(fields[1], '') AS f1, fields[2:] AS tokens FROM p1),
    p3 AS (SELECT *, split_part(f1, '#', 1) AS name, CASE WHEN contains(f1, '#') THEN substr(f1, instr(f1, '#') + 1) END AS id_hex, list_filter(tokens, lambda x: instr(x, ':') <= 1 OR instr(x, ':') = length(x)) AS bad FROM p2),
    parsed AS (SELECT *, CASE
        WHEN NOT ends_with(source, ';') THEN 'V1' WHEN NOT contains(body, '=') OR result = '' THEN 'V2' WHEN len(fields) = 0 THEN 'V3' WHEN NOT contains(f1, '#') THEN 'V4'
        WHEN NOT regexp_matches(name, '^[a-zA-Z][a-zA-Z0-9_]*(\.[a-zA-Z][a-zA-Z0-9_]*)?$') THEN 'V5' WHEN NOT regexp_matches(id_hex, '^[0-9a-fA-F]{1,8}$') THEN 'V6'
        WHEN regexp_matches(id_hex, '^0+$') THEN 'V7' WHEN len(bad) > 0 THEN 'V8' END AS rule FROM p3),
    good AS (SELECT * FROM parsed WHERE rule IS NULL),
    params AS (SELECT file, line, source, u.i AS pos, split_part(u.t, ':', 1) AS param, substr(u.t, instr(u.t, ':') + 1) AS type FROM good, unnest(list_transform(tokens, lambda t, i: {'t': t, 'i': i})) AS w(u)),
    par AS (SELECT *, nullif(regexp_extract(type, '^(flags\d*)\.(\d+)\?(.+)$', 1), '') AS flag, nullif(regexp_extract(type, '^(flags\d*)\.(\d+)\?(.+)$', 2), '') AS bit,
        CASE WHEN regexp_matches(type, '^(flags\d*)\.(\d+)\?(.+)$') THEN regexp_extract(type, '^(flags\d*)\.(\d+)\?(.+)$', 3) ELSE type END AS inner_type FROM params)"""
)
_SYNTAX = """SELECT file, line, rule, CASE rule WHEN 'V1' THEN 'no semicolon at the end' WHEN 'V2' THEN 'no result type' WHEN 'V3' THEN 'no name' WHEN 'V4' THEN 'no id behind the name'
      WHEN 'V5' THEN 'not a name: "' || name || '"' WHEN 'V6' THEN 'not an id: "' || id_hex || '"' WHEN 'V7' THEN 'the id is zero' ELSE 'not a parameter: "' || bad[1] || '"' END AS reason, TRUE AS fatal FROM parsed WHERE rule IS NOT NULL"""
_DUPS = """SELECT file, line, 'V9' AS rule, 'id #' || id_hex || ' belongs to ' || n1 || ' of line ' || l1 AS reason, TRUE AS fatal FROM (SELECT *, row_number() OVER w AS n, first_value(name) OVER w AS n1, first_value(line) OVER w AS l1 FROM good WINDOW w AS (PARTITION BY file, id_hex ORDER BY line)) WHERE n > 1
    UNION ALL SELECT file, line, 'V10', name || ' is there since line ' || l1, TRUE FROM (SELECT *, row_number() OVER w AS n, first_value(line) OVER w AS l1 FROM good WINDOW w AS (PARTITION BY file, name ORDER BY line)) WHERE n > 1"""
_PARAMS = """SELECT file, line, 'V11' AS rule, 'second parameter "' || param || '"' AS reason, TRUE AS fatal FROM (SELECT *, row_number() OVER (PARTITION BY file, line, param ORDER BY pos) AS n FROM par) WHERE n > 1
    UNION ALL SELECT file, line, 'V12', 'no flag word "' || flag || '" stands before parameter "' || param || '"', TRUE FROM (
      SELECT *, row_number() OVER (PARTITION BY file, line, flag ORDER BY pos) AS n FROM par a WHERE flag IS NOT NULL AND NOT EXISTS (SELECT 1 FROM par b WHERE b.file = a.file AND b.line = a.line AND b.pos < a.pos AND b.param = a.flag AND b.type = '#')) WHERE n = 1
    UNION ALL SELECT file, line, 'V13', 'bit ' || bit || ' of parameter "' || param || '" is above 31', TRUE FROM par WHERE flag IS NOT NULL AND coalesce(TRY_CAST(bit AS INT), 99) > 31"""
_ATOMS = r""",
    used AS (SELECT file, line, param, inner_type AS t FROM par WHERE type <> '#' UNION ALL SELECT file, line, NULL, result FROM good),
    atoms AS (SELECT file, line, param, unnest(CASE WHEN starts_with(b, 'Vector<') AND ends_with(b, '>') THEN ['Vector', regexp_replace(b[8:-2], '^[!%]+', '')] ELSE [b] END) AS atom FROM (SELECT file, line, param, regexp_replace(t, '^[!%]+', '') AS b FROM used))"""
_TYPES = """SELECT file, line, 'V14' AS rule, CASE WHEN param IS NULL THEN 'nothing makes the result "' || atom || '"' ELSE 'nothing makes "' || atom || '", the type of parameter "' || param || '"' END AS reason, FALSE AS fatal
    FROM atoms WHERE atom <> '' AND atom NOT IN ('true','int','long','double','string','bytes','Bool','#','int128','int256','Type','Object','Vector','True') AND atom NOT IN (SELECT result FROM good WHERE kind = 'constructor')"""
_REST = "substr(body, instr(body, ' ') + 1)"
_NORM = "rtrim(replace(replace(%s || ' ' || " + _REST + ", '<', ' '), '>', ''))"
_STRIPPED = r"regexp_extract(name, '^(.+?)\d+$', 1)"
_IDS = f"""SELECT file, line, 'V15' AS rule, 'id #' || id_hex || ' is not the checksum of ' || name AS reason, FALSE AS fatal FROM good, crc_table
    WHERE ('0x' || id_hex)::BIGINT <> {B.duck_crc(_NORM % 'name')} AND NOT ({_STRIPPED} <> '' AND ('0x' || id_hex)::BIGINT = {B.duck_crc(_NORM % _STRIPPED)})"""

QUERIES = {f.__name__: f for f in (idl_parse, validate_syntax, validate_dups, validate_params, validate_types, validate_ids, validate_summary, problems_shown, id_roundtrip, decl_checksum)}
ORACLES = {
    "idl_parse": _LINES + _SECTION + r"""
        SELECT file, line, kind, regexp_extract(source, '(\S+)#(\w+) *(\{\S+\})? *#* *\[* *([^}=\]]*) *\]* = ([^;]+)', 1) AS name, regexp_extract(source, '(\S+)#(\w+) *(\{\S+\})? *#* *\[* *([^}=\]]*) *\]* = ([^;]+)', 2) AS id_hex,
        trim(regexp_extract(source, '(\S+)#(\w+) *(\{\S+\})? *#* *\[* *([^}=\]]*) *\]* = ([^;]+)', 4)) AS params, trim(regexp_extract(source, '(\S+)#(\w+) *(\{\S+\})? *#* *\[* *([^}=\]]*) *\]* = ([^;]+)', 5)) AS result
        FROM body_lines WHERE regexp_matches(source, '(\S+)#(\w+) *(\{\S+\})? *#* *\[* *([^}=\]]*) *\]* = ([^;]+)')""",
    "validate_syntax": _LINES + _STRICT + " " + _SYNTAX,
    "validate_dups": _LINES + _STRICT + " " + _DUPS,
    "validate_params": _LINES + _STRICT + " " + _PARAMS,
    "validate_types": _LINES + _STRICT + _ATOMS + " " + _TYPES,
    "validate_ids": _LINES + _STRICT + " " + _IDS,
    "validate_summary": _LINES + _STRICT + _ATOMS + f""", found AS ({_SYNTAX} UNION ALL {_DUPS} UNION ALL {_PARAMS} UNION ALL {_TYPES} UNION ALL {_IDS})
        SELECT file, count(*) AS problems, count(*) FILTER (fatal) AS fatal, greatest(count(*) - 10, 0) AS hidden, least(count(*), 10) AS shown FROM found GROUP BY file""",
    "problems_shown": _LINES + _STRICT + _ATOMS + f""", found AS ({_SYNTAX} UNION ALL {_DUPS} UNION ALL {_PARAMS} UNION ALL {_TYPES} UNION ALL {_IDS})
        SELECT file, place, line, rule, reason, fatal FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, rule, reason) AS place FROM found) WHERE place <= 10""",
    "id_roundtrip": """WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey * 71549 + l_partkey * 31 AS v, coalesce(TRY_CAST(CASE WHEN l_linenumber = 3 THEN 'abc' ELSE CAST(-(l_orderkey * 65537 + l_partkey) AS VARCHAR) END AS BIGINT), 0) & 4294967295 AS h FROM lineitem)
        SELECT l_orderkey, l_linenumber, lower(to_hex(h)) AS hex_id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS signed_id, v & 4294967295 AS unsigned_id,
          CASE WHEN (v & 4294967295) >= 2147483648 THEN (v & 4294967295) - 4294967296 ELSE v & 4294967295 END AS back, CASE WHEN l_orderkey > 0 AND (l_orderkey & (l_orderkey - 1)) = 0 THEN CAST(log2(l_orderkey) AS INT) END AS bit,
          ((v >> 24) & 255) = ((v >> 16) & 255) AND ((v >> 16) & 255) = ((v >> 8) & 255) AS placeholder FROM r""",
    "decl_checksum": f"WITH {B.DUCK_CRC_TABLE}, {B.decl('duckdb')}, c AS (SELECT decl.*, {B.duck_crc('norm')} AS id FROM decl, crc_table) SELECT k, nm || ps || ' = ' || res AS declaration, id, nm || '#' || lower(to_hex(id)) || ps || ' = ' || res || ';' AS line FROM c",
}
