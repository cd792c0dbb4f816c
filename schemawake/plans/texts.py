"""Queries over classes, names, texts, pages and event streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import declarations as D
from ..functions import naming as N
from ..operators import changelog, classes, pages, parse
from ..scratch import folder
from ..sources import manifests as M
from ..streaming import incremental as S
from . import bindings as B

_ONE = "one AS (SELECT 1 AS x)"
_CLASSES = "SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'TL_' || replace(p_name, ' ', '_') || '_layer' || (p_partkey % 200) WHEN 1 THEN 'TL_' || replace(p_name, ' ', '_') || '_old' WHEN 2 THEN 'TL_' || replace(p_name, ' ', '_') || '_' || (p_partkey % 300) WHEN 3 THEN 'partsSold' || p_partkey WHEN 4 THEN 'parts' || upper(p_type) WHEN 5 THEN replace(p_name, ' ', '') || 'Old' || (p_partkey % 10) ELSE 'TL_' || replace(p_name, ' ', '_') END AS class, p_partkey * 65793 % 4294967296 AS id FROM part"


def class_filters(spark, sf_dir):
    rows = B.load(spark, sf_dir, _ONE, _CLASSES)
    kept = classes.without_numbered(classes.without_legacy(rows))
    return kept.select("k", "class", classes.is_placeholder(F.col("id")).alias("placeholder"), D.lower_leaf(F.col("class")).alias("lowered"))


def class_name_normalise(spark, sf_dir):
    rows = B.load(spark, sf_dir, _ONE, _CLASSES)
    name = N.class_name(F.col("class"), F.when((F.col("k") % 7).isin(3, 4), "TL_parts").otherwise(""))
    return rows.select("k", name["name"].alias("name"), name["layer"].alias("layer"))


def param_name_fix(spark, sf_dir):
    rows = B.load(spark, sf_dir, _ONE, "SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 'isAdmin' WHEN 1 THEN 'is' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) WHEN 2 THEN 'webPage' WHEN 3 THEN 'stickerItem' WHEN 4 THEN 'hash2' WHEN 5 THEN 'viaInvite' WHEN 6 THEN 'doc' ELSE lower(p_type) || 'BySize' END AS name FROM part")
    return rows.select("k", "name", N.param_name(F.col("name")).alias("fixed"))


def java_type_map(spark, sf_dir):
    rows = B.load(spark, sf_dir, _ONE, "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'Integer' WHEN 1 THEN 'boolean' WHEN 2 THEN 'byte[]' WHEN 3 THEN 'long' WHEN 4 THEN 'TL_' || lower(p_type) ELSE lower(p_type) END AS type, p_partkey % 3 AS depth FROM part")
    return rows.select("k", N.java_type(F.col("type"), F.col("depth").cast("int")).alias("type"))


def inherit_members(spark, sf_dir):
    rows = B.load(spark, sf_dir, B.TREE, "SELECT * FROM tree")
    return classes.inherited_members(rows.select("class", "parent"), rows.select("class", "member", "value"))


def objects_of_classes(spark, sf_dir):
    rows = B.load(spark, sf_dir, _ONE, "SELECT p_partkey AS k, 'TL_' || replace(p_name, ' ', '_') || '_n' || p_partkey || 'x' AS class, p_partkey * 7 + 300 AS id, p_type FROM part")
    f = F.when(F.col("k") % 3 == 0, F.array(F.lit("deserializeResponse"))).when(F.col("k") % 3 == 1, F.array(F.lit("readParams"))).otherwise(F.array(F.lit("other")))
    fields = F.array(F.struct(F.lit("isAdmin").alias("name"), F.lit("Integer").alias("type"), F.lit(1).alias("nesting")))
    table = rows.select(F.lit("TLRPC").alias("pkg"), "class", F.concat(F.lit("TL_"), F.lower("p_type")).alias("parent"), "id", f.alias("functions"), fields.alias("fields"))
    return classes.objects_from_classes(table, 100).select("class", "kind", "id", "name", "result", F.trim(D.params_text(F.col("params"))).alias("params"))


_DOCS = "SELECT doc_id, text FROM documents"


def text_sanitise(spark, sf_dir):
    rows = B.load(spark, sf_dir, _ONE, _DOCS)
    return rows.select("doc_id", N.markup_to_html(F.col("text")).alias("html"))


def described_reconcile(spark, sf_dir):
    items = B.load(spark, sf_dir, _ONE, "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Added ' ELSE '' END || replace(p_name, ' ', '.') || CASE WHEN p_partkey % 3 = 0 THEN '#' || p_partkey ELSE ':' END AS name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'about *' || p_type || '*' END AS description, p_partkey AS pos FROM part")
    expected = B.load(spark, sf_dir, _ONE, "SELECT DISTINCT replace(p_name, ' ', '.') AS name FROM part WHERE p_size > 10")
    return changelog.reconcile(expected, changelog.described_names(items))


def described_items(spark, sf_dir):
    items = B.load(spark, sf_dir, _ONE, "SELECT 'Added ' || replace(p_name, ' ', '.') || CASE WHEN p_partkey % 3 = 0 THEN '#' || p_partkey ELSE ':' END AS name, 'about *' || p_type || '*' AS description, p_partkey AS pos FROM part")
    return changelog.described_names(items)


def stats_lines(spark, sf_dir):
    rows = B.load(spark, sf_dir, _ONE, "SELECT p_size AS k, count(*) FILTER (WHERE p_partkey % 3 = 0) AS additions, count(*) FILTER (WHERE p_partkey % 3 = 1) AS changes, count(*) FILTER (WHERE p_partkey % 3 = 2) AS deletions FROM part GROUP BY p_size")
    return rows.select("k", changelog.stats_text().alias("line"))


def file_actions(spark, sf_dir):
    new = B.load(spark, sf_dir, _ONE, "SELECT DISTINCT 'p/' || p_name AS path FROM part WHERE p_size > 5")
    old = B.load(spark, sf_dir, _ONE, "SELECT 'p/' || p_name AS path, min(p_brand) AS sha FROM part WHERE p_size > 25 GROUP BY 1")
    return changelog.classify_files(new, old)


def line_index(spark, sf_dir):
    lines = B.decl_lines(spark, sf_dir)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "source"))), lambda x: x["source"]), "\n")
    return changelog.line_index(lines.groupBy("file").agg(text.alias("text")), ["file"])


def dup_lines(spark, sf_dir):
    """Lines of documents with how often they occur, first in which document, and in how many."""
    rows = B.load(spark, sf_dir, _ONE, _DOCS).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return rows.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.count_distinct("doc_id").alias("docs")).where("n > 1")


def line_split(spark, sf_dir):
    rows = B.load(spark, sf_dir, _ONE, "SELECT CAST(doc_id AS VARCHAR(20)) AS file, text FROM documents")
    lines = parse.with_section(parse.lines_of(rows))
    return lines.groupBy("file").agg(F.count("*").alias("n"), F.sum("line").alias("line_sum"), F.sum(F.length("source")).alias("chars"))


def version_codes(spark, sf_dir):
    return B.load(spark, sf_dir, B.VER, "SELECT code, version_name FROM ver").select("code", "version_name", D.version_code(F.col("version_name")).alias("version_code"))


def _watermarks(spark, sf_dir):
    return B.load(spark, sf_dir, B.VER, "SELECT source, code, force FROM ver"), B.load(spark, sf_dir, B.VER, "SELECT source, last_code FROM marks")


def watermark_new(spark, sf_dir):
    return S.new_versions(*_watermarks(spark, sf_dir)).select("source", "code")


def watermark_advance(spark, sf_dir):
    v, m = _watermarks(spark, sf_dir)
    return S.advanced(m, S.new_versions(v, m))


def dispatch_one(spark, sf_dir):
    rows = B.load(spark, sf_dir, _ONE, "SELECT user_id AS batch, CASE event_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'lib' ELSE 'android' END AS source, event_id AS code, user_id % 2 = 0 AS preview FROM events")
    return S.dispatched(rows, "batch", "preview").select("batch", "source", "code")


def announce(spark, sf_dir):
    latest = B.load(spark, sf_dir, B.RELEASED, "SELECT id AS source, max(layer) AS layer FROM released GROUP BY id")
    told = B.load(spark, sf_dir, B.RELEASED, "SELECT id AS source, CASE WHEN id % 4 = 0 THEN 0 ELSE min(layer) END AS layer FROM released GROUP BY id")
    return S.announcements(latest, told)


_EVENTS = "SELECT event_id, user_id, ts, event_type FROM events"


def dup_suppress(spark, sf_dir):
    return S.without_repeats(B.load(spark, sf_dir, _ONE, _EVENTS), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


def throttle_3s(spark, sf_dir):
    """Events at most once in 20 minutes per user (the test events are minutes apart)."""
    return S.throttled(B.load(spark, sf_dir, _ONE, "SELECT event_id, user_id, ts FROM events"), "user_id", ["ts", "event_id"], 1200.0).select("event_id", "user_id")


def _event_stream(spark, sf_dir):
    at = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(at).schema).option("pathGlobFilter", "*.parquet").parquet(at if _is_dir(spark, at) else f"{sf_dir}/events.parque[t]")


def throttle_values(spark, sf_dir):
    """Events whose type differs from the user's last one let through and that come 20 minutes or more after it, or a day."""
    rows = B.load(spark, sf_dir, _ONE, _EVENTS)
    return S.throttled_values(rows, "user_id", "event_type", ["ts", "event_id"], 1200.0).select("event_id", "user_id", "event_type")


def throttle_stream(spark, sf_dir):
    """The same from the events as a stream, with state that ends."""
    root = folder(spark, "throttle")
    stream = S.throttled_stream(_event_stream(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), "user_id", "ts", "event_type", 1200.0, then=("event_id",))
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "user_id", "event_type")


def manifest_stream(spark, sf_dir):
    """Version manifests of the events as a stream that is stopped and started again as more arrive; what its batches have written."""
    root = folder(spark, "manifests")
    rows = B.load(spark, sf_dir, B.VER, "SELECT source, major, max(code) AS code, max_by(version_name, code) AS version_name FROM ver GROUP BY source, major")
    for turn in range(2):
        half = rows.where(F.col("code") <= rows.agg(F.percentile_approx("code", 0.5)).first()[0]) if not turn else rows
        half.repartition("source", "code").write.mode("overwrite").partitionBy("source", "code").json(f"{root}/in")

        def process(batch, number):
            batch.select("source", "code", "version_name").write.mode("overwrite").parquet(f"{root}/out/batch={number}")

        query = M.manifest_stream(spark, f"{root}/in").writeStream.foreachBatch(process).option("checkpointLocation", f"{root}/checkpoint").start()
        query.processAllAvailable()
        query.stop()
    return spark.read.parquet(f"{root}/out").select("source", "code", "version_name")


def stream_ingest(spark, sf_dir):
    """The events as a file stream, delivered twice: per batch those above their source's watermark are written, then the watermark goes up; the result is what was written."""
    root = folder(spark, "ingest")
    B.load(spark, sf_dir, B.VER, "SELECT source, CAST(last_code AS BIGINT) AS last_code FROM marks").write.parquet(f"{root}/marks")
    stream = _event_stream(spark, sf_dir)
    stream = stream.withColumns({"source": F.when(F.col("event_type") == "click", "android").otherwise(F.col("event_type")), "code": F.col("event_id")})
    for turn in range(2):

        def process(batch, number, turn=turn):
            batch.select("event_id", "user_id", "event_type").write.mode("overwrite").parquet(f"{root}/out/turn={turn}/batch={number}")

        S.ingest_new(stream, process, f"{root}/marks", f"{root}/checkpoint-{turn}")
    return spark.read.parquet(f"{root}/out").select("event_id", "user_id", "event_type")


def _is_dir(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")


def page_tag_audit(spark, sf_dir):
    return pages.tag_audit(_pages(spark, sf_dir))


def page_tag_balance(spark, sf_dir):
    return pages.tag_balance(_pages(spark, sf_dir))


#: Pages with one fault each: crossed tags, a closing tag too many, one too few, a child where none may be, self-closed tags, capitals.
_NESTED = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN '<b><i></b></i>' || html WHEN 1 THEN html || '</p>' WHEN 2 THEN '<p>' || html WHEN 3 THEN '<video src="v"> </video>' || html WHEN 4 THEN '<video src="v"></video><br/><p>a<hr>b</p>' WHEN 5 THEN '<B>x</b>'
      WHEN 6 THEN '<ul><li>' || page_id || '<ol><li><b>x</b></li></ol></li></ul>' ELSE html END AS html FROM pages"""


def page_nesting(spark, sf_dir):
    return pages.nesting(B.load(spark, sf_dir, _ONE, _NESTED))


def page_list_items(spark, sf_dir):
    return pages.list_items(_pages(spark, sf_dir))


#: Pages as release notes: an older version's section, then one that has the page's own list behind lists within lists, its end, or no list at all.
_NOTES = """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 9999 ELSE 100 + page_id % 50 END AS version, replace(replace(html, '<nav><ul>', '<h3>Layer ' || (700 + page_id % 50) || '</h3><ul><li>old</li></ul><h3 id="x"><b>Layer</b> ' || (100 + page_id % 50) || '</h3><p>intro</p>' || CASE WHEN page_id % 4 = 1 THEN '<h5>end</h5>' ELSE '' END || '<ul>' || CASE WHEN page_id % 4 = 2 THEN '<li>outer<ul class="in"><li>inner<ul><li>deep</li></ul></li><li>next</li></ul></li>' ELSE '' END),
      '</ul></nav>', '</ul><ul><li>second</li></ul><h3>Layer ' || (100 + page_id % 50) || '</h3><ul><li>late</li></ul>') AS html FROM pages"""


def page_version_section(spark, sf_dir):
    return pages.version_section(B.load(spark, sf_dir, _ONE, _NOTES), "version")


def page_links(spark, sf_dir):
    return pages.rebased_links(_pages(spark, sf_dir), "https://example.org")


_FNS = (
    class_filters, class_name_normalise, param_name_fix, java_type_map, inherit_members, objects_of_classes, text_sanitise, described_reconcile, described_items, stats_lines, file_actions, line_index, dup_lines, line_split,
    version_codes, watermark_new, watermark_advance, dispatch_one, announce, dup_suppress, throttle_3s, throttle_values, throttle_stream, manifest_stream, stream_ingest, page_tag_audit, page_tag_balance, page_nesting, page_list_items, page_version_section, page_links,
)
QUERIES = {f.__name__: f for f in _FNS}

_V = f"WITH {B.VER}"
_TAGS = r"""WITH t AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>'), lambda x, i: {'x': x, 'i': i})) AS u FROM pages),
    tags AS (SELECT page_id, u.i AS seq, u.x[2] = '/' AS closing, regexp_extract(u.x, '<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>', 2) AS tag, regexp_extract(u.x, '<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>', 3) AS attrs FROM t)"""
ORACLES = {
    "class_filters": f"""WITH c AS ({_CLASSES}), l AS (SELECT * FROM c WHERE NOT regexp_matches(class, 'Old[0-9]*$|ToBeDeprecated$|(?i:ToDelete$)|Layer[0-9]+$|(?i:_legacy$)|(?i:^TL_contactLink)'))
        SELECT k, class, ((id >> 24) & 255) = ((id >> 16) & 255) AND ((id >> 16) & 255) = ((id >> 8) & 255) AS placeholder, lower(class[1]) || class[2:] AS lowered FROM l
        WHERE NOT (regexp_matches(class, '^\\S+[^0-9p][0-9]+$') AND regexp_replace(class, '[0-9]+$', '') IN (SELECT class FROM l))""",
    "class_name_normalise": """SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 3 THEN 'parts.sold' || p_partkey WHEN p_partkey % 7 = 4 THEN 'parts.' || lower(p_type[1]) || upper(p_type[2:]) WHEN p_partkey % 7 = 5 THEN CASE WHEN starts_with(p_name, 'old') THEN '' ELSE replace(p_name, ' ', '') || 'Old' || (p_partkey % 10) END ELSE replace(p_name, ' ', '.') || CASE WHEN p_partkey % 7 = 2 AND p_partkey % 300 < 100 THEN '.' || (p_partkey % 300) ELSE '' END END AS name,
        CASE p_partkey % 7 WHEN 0 THEN p_partkey % 200 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN p_partkey % 300 >= 100 THEN p_partkey % 300 ELSE 0 END WHEN 5 THEN CASE WHEN starts_with(p_name, 'old') THEN 1 ELSE 0 END ELSE 0 END AS layer FROM part""",
    "param_name_fix": """SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 'isAdmin' WHEN 1 THEN 'is' || upper(p_type[1]) || lower(p_type[2:]) WHEN 2 THEN 'webPage' WHEN 3 THEN 'stickerItem' WHEN 4 THEN 'hash2' WHEN 5 THEN 'viaInvite' WHEN 6 THEN 'doc' ELSE lower(p_type) || 'BySize' END AS name,
        CASE p_partkey % 8 WHEN 0 THEN 'is_admin' WHEN 1 THEN lower(p_type) WHEN 2 THEN 'page' WHEN 3 THEN 'sticker' WHEN 4 THEN 'hash' WHEN 5 THEN 'via_request' WHEN 6 THEN 'id' ELSE lower(p_type) || '_by_size' END AS fixed FROM part""",
    "java_type_map": """SELECT p_partkey AS k, repeat('Vector<', p_partkey % 3) || CASE p_partkey % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'Bool' WHEN 2 THEN 'bytes' WHEN 3 THEN 'long' ELSE upper(p_type[1]) || lower(p_type[2:]) END || repeat('>', p_partkey % 3) AS type FROM part""",
    "inherit_members": f"""WITH RECURSIVE {B.TREE}, up(class, ancestor, depth) AS (SELECT class, class, 0 FROM tree UNION ALL SELECT u.class, t.parent, u.depth + 1 FROM up u JOIN tree t ON u.ancestor = t.class WHERE t.parent IS NOT NULL)
        SELECT class, member, value, depth FROM (SELECT u.class, t.member, t.value, u.depth, row_number() OVER (PARTITION BY u.class, t.member ORDER BY u.depth) AS n FROM up u JOIN tree t ON t.class = u.ancestor) WHERE n = 1""",
    "objects_of_classes": """SELECT 'TL_' || replace(p_name, ' ', '_') || '_n' || p_partkey || 'x' AS class, CASE p_partkey % 3 WHEN 0 THEN 'method' ELSE 'constructor' END AS kind, p_partkey * 7 + 300 AS id, replace(p_name, ' ', '.') || '.n' || p_partkey || 'x' AS name,
        upper(p_type[1]) || lower(p_type[2:]) AS result, 'is_admin:Vector<int>' AS params FROM part WHERE p_partkey % 3 < 2 AND NOT ((((p_partkey * 7 + 300) >> 24) & 255) = (((p_partkey * 7 + 300) >> 16) & 255) AND (((p_partkey * 7 + 300) >> 16) & 255) = (((p_partkey * 7 + 300) >> 8) & 255))""",
    "text_sanitise": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(trim(text, E' \t\n\r\f\x0b'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '`([^`\n]+?)`', '<code>\1</code>', 'g'), '\*\*(.+?)\*\*', '<b>\1</b>', 'g'), '(^|[^*\w])\*([^\s*](?:[^*\n]*?[^\s*])?)\*([^*\w]|$)', '\1<i>\2</i>\3', 'g') AS html FROM documents""",
    "described_reconcile": "SELECT (SELECT count(DISTINCT p_name) FROM part WHERE p_size > 10) AS expected, (SELECT count(DISTINCT p_name) FROM part WHERE p_partkey % 5 <> 0) AS described, (SELECT count(DISTINCT p_name) FROM part WHERE p_size > 10) <> (SELECT count(DISTINCT p_name) FROM part WHERE p_partkey % 5 <> 0) AS mismatch",
    "described_items": "SELECT replace(p_name, ' ', '.') AS name, 'about <i>' || max_by(p_type, p_partkey) || '</i>' AS description FROM part GROUP BY 1",
    "stats_lines": "SELECT p_size AS k, a || ' addition' || CASE WHEN a = 1 THEN '' ELSE 's' END || ', ' || c || ' change' || CASE WHEN c = 1 THEN '' ELSE 's' END || ', ' || d || ' deletion' || CASE WHEN d = 1 THEN '' ELSE 's' END AS line FROM (SELECT p_size, count(*) FILTER (p_partkey % 3 = 0) AS a, count(*) FILTER (p_partkey % 3 = 1) AS c, count(*) FILTER (p_partkey % 3 = 2) AS d FROM part GROUP BY 1)",
    "file_actions": "SELECT DISTINCT 'p/' || p_name AS path, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size > 25) THEN 'update' ELSE 'create' END AS action FROM part WHERE p_size > 5",
    "line_index": "WITH " + B.lines("duckdb") + r", n AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line, source) AS line, regexp_extract(source, '^\S+#([0-9a-f]+)', 1) AS id_hex FROM lines) SELECT file, id_hex, max(line) AS line FROM n WHERE id_hex <> '' GROUP BY 1, 2",
    "dup_lines": "SELECT line, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY 1 HAVING count(*) > 1",
    "line_split": r"WITH u AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'x': trim(x, E' \t\r'), 'i': i})) AS u FROM documents) SELECT CAST(doc_id AS VARCHAR) AS file, count(*) AS n, CAST(sum(u.i) AS BIGINT) AS line_sum, CAST(sum(length(u.x)) AS BIGINT) AS chars FROM u WHERE u.x <> '' AND NOT starts_with(u.x, '//') GROUP BY 1",
    "version_codes": _V + " SELECT code, version_name, list_reduce(list_transform(string_split(version_name, '.'), lambda x: coalesce(TRY_CAST(CASE WHEN regexp_matches(x, '^[0-9]+$') THEN x END AS BIGINT), 0)), lambda a, b: a * 100 + b) AS version_code FROM ver",
    "watermark_new": _V + " SELECT v.source, v.code FROM ver v LEFT JOIN marks m USING (source) WHERE v.code > coalesce(m.last_code, 0) OR (v.force AND v.source = 'android')",
    "watermark_advance": _V + " SELECT source, max(code) AS last_code FROM (SELECT source, last_code AS code FROM marks UNION ALL SELECT v.source, v.code FROM ver v LEFT JOIN marks m USING (source) WHERE v.code > coalesce(m.last_code, 0) OR (v.force AND v.source = 'android')) GROUP BY source",
    "dispatch_one": "SELECT batch, source, code FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY r, code DESC) AS n FROM (SELECT user_id AS batch, event_id % 3 AS r, CASE event_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'lib' ELSE 'android' END AS source, event_id AS code FROM events WHERE user_id % 2 = 0 OR event_id % 3 = 2)) WHERE n = 1",
    "announce": f"WITH {B.RELEASED} SELECT id AS source, max(layer) AS layer FROM released WHERE id % 4 <> 0 GROUP BY id HAVING max(layer) > min(layer)",
    "dup_suppress": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type",
    "throttle_3s": """WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2), n AS (SELECT e.user_id, e.ts, e.event_id, x.ts AS next_ts FROM e ASOF LEFT JOIN e x ON e.user_id = x.user_id AND e.ts + INTERVAL 1200 SECOND <= x.ts),
        k AS (SELECT n.* FROM n JOIN (SELECT user_id, min(ts) AS ts FROM n GROUP BY 1) f USING (user_id, ts) UNION ALL SELECT n.* FROM k JOIN n ON n.user_id = k.user_id AND n.ts = k.next_ts) SELECT event_id, user_id FROM k""",
    "stream_ingest": _V + " SELECT event_id, user_id, event_type FROM events e LEFT JOIN marks m ON m.source = CASE e.event_type WHEN 'click' THEN 'android' ELSE e.event_type END WHERE event_id > coalesce(last_code, 0)",
    "page_tag_audit": _TAGS + r""", a AS (SELECT page_id, tag, list_transform(regexp_extract_all(attrs, '([a-zA-Z-]+)\s*=', 1), lambda x: lower(x)) AS names, CASE tag WHEN 'a' THEN 'href' WHEN 'iframe' THEN 'src' WHEN 'img' THEN 'src' WHEN 'video' THEN 'src' END AS need FROM tags WHERE NOT closing)
        SELECT page_id, tag, count(*) AS n, tag IN ('a','aside','b','blockquote','br','code','em','figcaption','figure','h3','h4','hr','i','iframe','img','li','ol','p','pre','s','strong','u','ul','video') AS allowed, count(*) FILTER (need IS NOT NULL AND NOT list_contains(names, need)) AS missing_attr, count(*) FILTER (len(list_filter(names, lambda x: need IS NULL OR x <> need)) > 0) AS extra_attr FROM a GROUP BY page_id, tag""",
    "page_tag_balance": _TAGS + """, l AS (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY seq) AS level FROM tags WHERE tag NOT IN ('br', 'hr', 'img'))
        SELECT page_id, tag, count(*) FILTER (NOT closing) AS opened, count(*) FILTER (closing) AS closed, min(level) >= 0 AND sum(CASE WHEN closing THEN -1 ELSE 1 END) = 0 AS balanced FROM l GROUP BY page_id, tag""",
    "page_list_items": r"""WITH s AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '(?s)<li>(.*?)</li>', 1) AS items FROM pages), u AS (SELECT page_id, unnest(list_transform(CASE WHEN len(items) > 0 THEN items ELSE ['no changelog'] END, lambda x, i: {'x': x, 'i': i})) AS u FROM s)
        SELECT page_id, u.i - 1 AS pos, replace(replace(replace(replace(replace(regexp_replace(u.x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS item FROM u""",
    "page_version_section": r"""WITH s AS (SELECT page_id, CASE WHEN page_id % 4 > 1 THEN regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1) ELSE '' END AS items FROM pages)
        SELECT page_id, items <> '' AS found, CASE WHEN items = '' THEN 'no changelog' ELSE trim(CASE WHEN page_id % 4 = 2 THEN '• outer• inner• deep• next' ELSE '' END || replace(replace(items, '<li>', '• '), '</li>', ''), E' \t\r\n') END AS text FROM s""",
    "page_nesting": "WITH RECURSIVE src AS (" + _NESTED + r"""), t AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|[^<]+'), lambda x, i: {'x': x, 'i': i})) AS u FROM src),
        tok AS (SELECT page_id, u.i - 1 AS seq, regexp_extract(u.x, '<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>', 2) AS tag, starts_with(u.x, '</') AS closing, ends_with(u.x, '/>') OR regexp_extract(u.x, '<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>', 2) IN ('br', 'hr', 'img') AS alone FROM t),
        walk AS (SELECT page_id, 0::BIGINT AS seq, []::VARCHAR[] AS open, -1::BIGINT AS last, NULL::VARCHAR AS reason, NULL::VARCHAR AS tag, NULL::VARCHAR AS expected FROM src
          UNION ALL SELECT page_id, seq + (bad IS NULL)::INT, CASE WHEN bad IS NOT NULL OR tag = '' OR (NOT closing AND alone) THEN open WHEN closing THEN open[:-2] ELSE list_append(open, tag) END, CASE WHEN closing THEN last ELSE len(open) END, bad, CASE WHEN bad IS NOT NULL THEN tag END, CASE WHEN bad = 'other tag open' THEN open[-1] END
            FROM (SELECT w.page_id, w.seq, w.open, w.last, k.tag, k.closing, k.alone, CASE WHEN NOT k.closing THEN NULL WHEN len(w.open) = 0 THEN 'nothing open' WHEN w.open[-1] <> k.tag THEN 'other tag open' WHEN w.last = len(w.open) AND k.tag IN ('img', 'iframe', 'video', 'br', 'hr') THEN 'has content' END AS bad FROM walk w JOIN tok k ON k.page_id = w.page_id AND k.seq = w.seq WHERE w.reason IS NULL)),
        fin AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq DESC, reason NULLS LAST) = 1)
        SELECT page_id, reason IS NULL AND len(open) = 0 AS nested, CASE WHEN reason IS NULL AND len(open) > 0 THEN 'never closed' ELSE reason END AS reason, CASE WHEN reason IS NULL AND len(open) > 0 THEN open[-1] ELSE tag END AS tag, expected, CASE WHEN reason IS NOT NULL OR len(open) > 0 THEN seq::INT END AS seq FROM fin""",
    "page_links": """SELECT page_id, replace(html, 'href="/', 'href="https://example.org/') AS html, (length(html) - length(replace(html, 'href="/', ''))) // 7 AS links FROM pages""",
}
ORACLES["throttle_stream"] = ORACLES["throttle_values"] = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    k AS (SELECT user_id, n, event_id, event_type, TRUE AS ok, ts AS since, event_type AS latest FROM e WHERE n = 1
      UNION ALL SELECT user_id, n, event_id, event_type, ok, CASE WHEN ok THEN ts ELSE since END, CASE WHEN ok THEN event_type ELSE latest END
        FROM (SELECT e.*, k.since, k.latest, e.ts >= k.since + INTERVAL 86400 SECOND OR (e.event_type <> k.latest AND e.ts >= k.since + INTERVAL 1200 SECOND) AS ok FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1))
    SELECT event_id, user_id, event_type FROM k WHERE ok"""
ORACLES["manifest_stream"] = _V + """, v AS (SELECT source, major, max(code) AS code, max_by(version_name, code) AS version_name FROM ver GROUP BY 1, 2), half AS (SELECT source, max(code) AS top FROM v WHERE code <= (SELECT quantile_disc(code, 0.5) FROM v) GROUP BY 1)
    SELECT v.source, v.code, v.version_name FROM v LEFT JOIN half USING (source) WHERE top IS NULL OR code > top OR code <= (SELECT quantile_disc(code, 0.5) FROM v)"""
