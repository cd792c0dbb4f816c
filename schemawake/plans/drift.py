"""Queries over snapshots of all years, release history, pins and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canonical, changelog, commits, diff, history, merge, params, publish, render, repair, state
from ..functions import declarations as D
from ..functions import ids, naming
from ..scratch import folder, saved
from . import bindings as B

_SCOPE = ["version", "api", "kind"]


def _sides(spark, sf_dir):
    """Every year's snapshot and that of the year before under the same version, of the years that have both."""
    snap = B.snapshots(spark, sf_dir)
    # years are few; the next one's number is what both sides are matched by
    old = snap.withColumn("version", F.col("version") + 1)
    return tuple(x.join(F.broadcast(B.years(spark, sf_dir)), "version", "left_semi") for x in (old, snap))


def _all_years(spark, sf_dir):
    """Every year's diff against the year before it, in one job: each snapshot is read once and is both the new side of its year and the old side of the next."""
    sides = F.explode(F.array(F.struct(F.col("version"), F.lit(True).alias("fresh")), F.struct((F.col("version") + 1).alias("version"), F.lit(False).alias("fresh"))))
    both = B.snapshots(spark, sf_dir).withColumn("side", sides).drop("version").select("*", "side.*").drop("side")
    return diff.diff_sides(both.join(F.broadcast(B.years(spark, sf_dir)), "version", "left_semi"), _SCOPE)


def _flat(d):
    changed = F.array_join(F.transform("changed_fields", lambda f: F.concat(f["name"], F.lit(":"), f["old_type"], F.lit(">"), f["new_type"])), ",")
    return {"new_fields": F.array_join("new_fields", ","), "removed_fields": F.array_join("removed_fields", ","), "changed_fields": changed}


def snapshot_diff(spark, sf_dir):
    return _all_years(spark, sf_dir).select("version", "api", "kind", "name", "id", "change", "old_result", "new_result")


def param_diff(spark, sf_dir):
    d = _all_years(spark, sf_dir).where("change = 'changed'")
    return d.select("version", "name", *[c.alias(k) for k, c in _flat(d).items()])


def diff_all_years(spark, sf_dir):
    d = _all_years(spark, sf_dir)
    return d.select("version", "api", "kind", "name", "id", "change", F.size("new_fields").alias("n_new"), F.size("removed_fields").alias("n_removed"), F.size("changed_fields").alias("n_changed"), "old_result", "new_result")


def diff_stats(spark, sf_dir):
    return diff.diff_stats(_all_years(spark, sf_dir), ["version"])


def publish_gate(spark, sf_dir):
    d = diff.without_deleted(_all_years(spark, sf_dir))
    heads = d.select("version").distinct().select("version", F.when(F.col("version") % 3 == 0, 1).otherwise(5).alias("layer"), F.lit(3).alias("prev_layer"))
    return diff.publishable(d, heads, ["version"]).select("version", "layer", "prev_layer", "differences")


def changelog_lines(spark, sf_dir):
    return changelog.changelog_lines(_all_years(spark, sf_dir)).select("version", "section", "line")


def page_items(spark, sf_dir):
    return changelog.page_items(_all_years(spark, sf_dir), _SCOPE)


#: Objects whose parameters use object types: optional vectors and marked ones of the object's own result, else a primitive.
_CONTEXT = """cpar AS (SELECT s.version, s.pk AS pos, s.pname, CASE s.ptype WHEN 'A' THEN 'flags.1?Vector<' || 'Brand' || substr(p_brand, 7) || '_' || (s.version % 2) || '_' || (length(s.pname) % 7) || '>' WHEN 'R' THEN '!Brand' || substr(p_brand, 7) || '_' || (s.pk % 7) ELSE 'int' END AS ptype FROM sold s JOIN part ON s.pk = p_partkey)"""


def context_topk(spark, sf_dir):
    nested = "named AS (SELECT version, pos, array_sort(collect_list(named_struct('name', pname, 'type', ptype))) AS params FROM cpar GROUP BY version, pos)"
    snap = B.load(spark, sf_dir, f"{B.SNAP}, {_CONTEXT}, {nested}", "SELECT snap.* EXCEPT (result), result || '_' || (snap.pos % 7) AS result, params FROM snap JOIN named ON snap.version = named.version AND snap.pos = named.pos")
    old = snap.withColumn("version", F.col("version") + 1)
    old, new = (x.join(F.broadcast(B.years(spark, sf_dir)), "version", "left_semi") for x in (old, snap))
    return changelog.context_rows(new, diff.diff_snapshots(old, new, _SCOPE), ["version"]).select("version", "result", "place", F.regexp_extract("line", "^([^#]+)#", 1).alias("name"))


def report_links(spark, sf_dir):
    _, new = _sides(spark, sf_dir)
    links = new.where("id % 2 = 0").select(*_SCOPE, "id", F.concat(F.lit("https://example.org/"), F.col("id").cast("string")).alias("link"))
    described = new.where("version = 2000 and pos % 3 = 0").select("name", F.concat(F.lit("about "), "name").alias("description"))
    return changelog.report_rows(_all_years(spark, sf_dir).select(*_SCOPE, "name", "id", "change"), links, described, _SCOPE).select(*_SCOPE, "name", "change", "link", "description")


def removed_ids(spark, sf_dir):
    return history.removed_ids(B.load(spark, sf_dir, B.RELEASED, "SELECT * FROM released"))


def removed_ids_except(spark, sf_dir):
    return history.removed_ids_except(B.load(spark, sf_dir, B.RELEASED, "SELECT * FROM released"))


def release_catalog(spark, sf_dir):
    return history.release_catalog(B.load(spark, sf_dir, B.RELEASED, "SELECT * FROM released"), 1996)


def recent_trim(spark, sf_dir):
    rows = B.load(spark, sf_dir, "one AS (SELECT 1 AS x)", "SELECT o_custkey AS source, CAST(year(o_orderdate) AS INT) AS layer, max(o_orderdate) AS created_at FROM orders GROUP BY 1, 2")
    return history.trim_recent(rows, 2, ["source"]).select("source", "layer")


def role_rotate(spark, sf_dir):
    snaps = B.load(spark, sf_dir, "one AS (SELECT 1 AS x)", "SELECT o_custkey AS source, o_orderkey AS id, CASE n WHEN 1 THEN 'incoming' WHEN 2 THEN 'preview' WHEN 3 THEN 'stable' END AS role FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) AS x")
    recent = B.load(spark, sf_dir, B.RELEASED, "SELECT DISTINCT id AS source, layer FROM released WHERE layer >= 2000")
    return history.rotate_roles(snaps, recent, ["source"])


def baseline_pick(spark, sf_dir):
    heads = B.load(spark, sf_dir, B.RELEASED, "SELECT id AS source, max(layer) AS layer, CASE WHEN id % 3 = 0 THEN NULL ELSE min(layer) END AS stable, max(layer) - 1 AS preview FROM released GROUP BY id")
    recent = B.load(spark, sf_dir, B.RELEASED, "SELECT DISTINCT id AS source, layer FROM released WHERE layer >= 1999")
    return history.pick_baseline(heads, recent, ["source"])


_TYPES = """types AS (SELECT p_size AS scope, CASE WHEN p_partkey % 4 = 0 THEN 'ns.' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) || p_brand ELSE p_type || p_brand END AS type, p_partkey AS k, replace(p_name, ' ', '') AS nm FROM part),
    objects AS (SELECT p_size AS scope, CASE WHEN p_partkey % 10 = 0 THEN 'method' ELSE 'constructor' END AS kind, replace(p_name, ' ', '') AS name, p_type AS result FROM part)"""


def canonical_index(spark, sf_dir):
    return canonical.spelling_index(B.load(spark, sf_dir, _TYPES, "SELECT scope, type FROM types"), ["scope"])


def canonical_apply(spark, sf_dir):
    types = B.load(spark, sf_dir, _TYPES, "SELECT scope, type FROM types")
    preds = canonical.predicate_index(B.load(spark, sf_dir, _TYPES, "SELECT * FROM objects"), types, ["scope"])
    use = B.load(spark, sf_dir, _TYPES, "SELECT scope, k, CASE k % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'flags.2?Vector<' || lower(type) || '>' WHEN 2 THEN 'Vector<Vector<' || upper(type) || '>>' WHEN 3 THEN 'x.unknown' || k WHEN 4 THEN 'y.' || upper(nm) ELSE lower(type) END AS type FROM types")
    return canonical.canonical_types(use, canonical.spelling_index(types, ["scope"]), preds, ["scope"])


_RENAMES = "renames AS (SELECT 'Brand' || substr(p_brand, 7) AS new_name, min('old' || p_type) AS old_name FROM part WHERE p_partkey % 7 = 0 GROUP BY 1 UNION ALL SELECT 'A', 'olda')"


def rename_propagate(spark, sf_dir):
    """All years' objects as one scope: a name stands there once a year, with other parameters each time."""
    renames = B.load(spark, sf_dir, _RENAMES, "SELECT 'main' AS api, new_name, old_name FROM renames")
    out = canonical.propagate_renames(B.snapshots(spark, sf_dir), renames, ["api"])
    return out.select("version", "api", "name", "result", F.trim(D.params_text(F.col("params"))).alias("params"))


_RULES = "rules AS (SELECT p_partkey AS id, 'fixed.' || p_partkey AS name, p_type AS result FROM part WHERE p_partkey % 13 = 0)"


def override_apply(spark, sf_dir):
    rules = B.load(spark, sf_dir, _RULES, "SELECT * FROM rules").withColumn("params", F.array().cast("array<struct<name:string,type:string>>"))
    return canonical.apply_overrides(B.snapshots(spark, sf_dir), rules, ["version"]).select("version", "id", "name", "result", "overridden", F.size("params").alias("n_params"))


def override_stale(spark, sf_dir):
    return canonical.stale_overrides(B.snapshots(spark, sf_dir), B.load(spark, sf_dir, _RULES, "SELECT * FROM rules")).select("id", "name")


def deprecation_filter(spark, sf_dir):
    removed = history.removed_ids_except(B.load(spark, sf_dir, B.RELEASED, "SELECT * FROM released"))
    return repair.drop_deprecated(B.snapshots(spark, sf_dir), ["small_ring0", "red_widget1"], removed).select("version", "api", "id", "name")


def api_split(spark, sf_dir):
    rows = B.load(spark, sf_dir, "one AS (SELECT 1 AS x)", "SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 'decryptedMessage' || p_partkey ELSE replace(p_name, ' ', '.') END AS name, CASE WHEN p_partkey % 10 = 0 THEN TRUE WHEN p_partkey % 10 = 1 THEN NULL ELSE FALSE END AS force_secret FROM part")
    return repair.split_api(rows).select("k", "name", "api")


_PINS = """pins AS (SELECT 'os' || (s_suppkey % 3) AS os, 'o' || s_suppkey AS name, s_suppkey AS old_id, s_suppkey + 7 AS new_id FROM supplier),
    ops AS (SELECT 'os' || (s_suppkey % 3) AS os, 'o' || (s_suppkey + CASE WHEN s_suppkey % 4 = 1 THEN 1000000 ELSE 0 END) AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'delete' ELSE 'create' END AS op, s_suppkey + 1 AS old_id, s_suppkey + 2 AS new_id, s_suppkey AS seq FROM supplier WHERE s_suppkey % 4 < 3)"""


def pins_apply(spark, sf_dir):
    return state.apply_pin_operations(B.load(spark, sf_dir, _PINS, "SELECT * FROM pins"), B.load(spark, sf_dir, _PINS, "SELECT * FROM ops"))


def pins_store(spark, sf_dir):
    """The same changes on a store of hash buckets: deletes first, then writes, each of its own buckets only."""
    store = state.BucketStore(spark, folder(spark, "pins"), ["os", "name"], "os string, name string, old_id long, new_id long", 16)
    columns = "SELECT os, name, CAST(old_id AS BIGINT) AS old_id, CAST(new_id AS BIGINT) AS new_id"
    store.upsert(B.load(spark, sf_dir, _PINS, f"{columns}, CAST(0 AS BIGINT) AS seq FROM pins"), "seq")
    store.delete(B.load(spark, sf_dir, _PINS, "SELECT os, name FROM ops WHERE op = 'delete'"))
    store.upsert(B.load(spark, sf_dir, _PINS, f"{columns}, CAST(seq AS BIGINT) AS seq FROM ops WHERE op = 'create'"), "seq")
    return store.read()


def state_writes(spark, sf_dir):
    """Insert-if-absent and keyed delete on the release layers of the customers."""
    seen = B.load(spark, sf_dir, B.RELEASED, "SELECT DISTINCT layer, id FROM released WHERE layer < 1998")
    more = B.load(spark, sf_dir, B.RELEASED, "SELECT DISTINCT layer, id FROM released WHERE layer >= 1997")
    gone = B.load(spark, sf_dir, B.RELEASED, "SELECT DISTINCT id FROM released WHERE id % 5 = 0")
    return state.delete_keys(state.insert_absent(seen, more, ["layer", "id"]), gone, ["id"])


def newer_upstream(spark, sf_dir):
    rows = B.load(spark, sf_dir, "one AS (SELECT 1 AS x)", "SELECT o_custkey AS scope, CASE WHEN o_orderkey % 2 = 0 THEN 'desktop' ELSE 'lib' END AS source, max(CAST(year(o_orderdate) AS INT)) AS layer FROM orders GROUP BY 1, 2")
    return state.newer_upstream(rows, ["scope"])


#: The years that have a snapshot of their own and of the year before.
_PAIRS = "yr AS (SELECT DISTINCT version FROM snap), pairs AS (SELECT a.version FROM yr a JOIN yr b ON a.version = b.version + 1)"

#: Every year is merged into the year before; incoming rows come in another order, some under the name of a type, and secret ones are of the base's layer.
#: Some objects come twice or three times: under an unknown id, and again under their own id and another name.
_INPUTS = _PAIRS + """,
    base AS (SELECT snap.version + 1 AS version, api, kind, id, name, result, pos{more} FROM snap JOIN pairs ON snap.version + 1 = pairs.version),
    fresh AS (SELECT snap.version, api, kind, id, CASE WHEN pos % 190 = 0 THEN result WHEN pos % 19 = 0 THEN name || '_renamed' ELSE name END AS name, result, pos * 7919 % 1000003 * 10 AS pos, 'os' || (pos % 3) AS os, api = 'e2e' AS same_layer, pos AS own{more} FROM snap JOIN pairs ON snap.version = pairs.version),
    incoming AS (SELECT * FROM fresh UNION ALL SELECT version, api, kind, id + 77000000 AS id, name, 'Second' || (own % 5) AS result, pos + 1 AS pos, os, same_layer, own{more} FROM fresh WHERE own % 23 = 0
      UNION ALL SELECT version, api, kind, id, name || '_third' AS name, CASE WHEN own % 4 = 0 THEN 'Third' ELSE result END AS result, pos + CASE WHEN own % 3 = 0 THEN -1 ELSE 2 END AS pos, os, same_layer, own{more} FROM fresh WHERE own % 46 = 0 OR own % 31 = 0),
    pin AS (SELECT 'os' || (b.pos % 3) AS os, b.name, CASE WHEN b.pos % 34 = 0 THEN b.pos + 1000003 * 10 ELSE 5 END AS old_id, CASE WHEN b.pos % 51 = 0 THEN 1 ELSE b.id END AS new_id FROM base b WHERE b.version = 2000 AND b.pos % 17 = 0 AND b.pos % 3 > 0),
    gone AS (SELECT id FROM fresh WHERE own % 17 = 0 AND own % 5 = 0)"""
_MERGE = f"{B.SNAP}, {_INPUTS.format(more='')}"


def _merge_inputs(spark, sf_dir):
    """base, incoming, pins and removed, all derived from one copy of the snapshots that is written once."""
    read = _reader(spark, sf_dir, _INPUTS)
    return tuple(map(read, ("base", "incoming", "pin", "gone")))


def _reader(spark, sf_dir, inputs):
    """Gives the tables of inputs, derived from one copy of the snapshots that is written once; its few years are written too, so that joins with them move no snapshot."""
    saved(B.snapshots(spark, sf_dir), "snapshots").createOrReplaceTempView("sw_snap")
    saved(spark.sql(f"WITH snap AS (SELECT * FROM sw_snap), {_PAIRS} SELECT version FROM pairs"), "pairs").createOrReplaceTempView("sw_pairs")
    ctes = inputs.format(more=", params").replace(_PAIRS, "pairs AS (SELECT version FROM sw_pairs)").replace("FROM part", "FROM sw_part")
    return lambda x: spark.sql(f"WITH snap AS (SELECT * FROM sw_snap), {ctes} SELECT * FROM {x}")


#: Updates of the years: an object with a name that no validator lets through in 1995, some objects in both apis, rules that change every 13th object.
_UPDATE = _PAIRS + """,
    base AS (SELECT snap.version + 1 AS version, api, kind, id, name, result, pos{more} FROM snap JOIN pairs ON snap.version + 1 = pairs.version),
    fresh AS (SELECT snap.version, api, kind, id, name, result, pos, 'os' || (pos % 3) AS os, FALSE AS same_layer{more} FROM snap JOIN pairs ON snap.version = pairs.version),
    incoming AS (SELECT * FROM fresh UNION ALL SELECT version, 'e2e' AS api, kind, id, name, result, pos, os, same_layer{more} FROM fresh WHERE pos % 499 = 3 AND api = 'main'
      UNION ALL SELECT version, api, kind, id + 55000000 AS id, '1bad' || pos AS name, result, pos, os, same_layer{more} FROM fresh WHERE version = 1995 AND pos % 97 = 1),
    gone AS (SELECT id FROM fresh WHERE pos % 17 = 0 AND pos % 5 = 0), rules AS (SELECT p_partkey AS id, 'fixed.o' || p_partkey AS name, 'Fixed' AS result FROM part WHERE p_partkey % 13 = 0)"""


def publish_report(spark, sf_dir):
    """Every year's update of the year before, committed as one run and delivered twice; the report is read from what the first commit has left."""
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("sw_part")
    read = _reader(spark, sf_dir, _UPDATE)
    rules = read("rules").withColumn("params", F.array().cast("array<struct<name:string,type:string>>"))
    heads = read("pairs").select("version", F.when(F.col("version") % 3 == 0, 1).otherwise(5).alias("layer"), F.lit(3).alias("prev_layer"))
    pins = spark.createDataFrame([], "os string, name string, old_id long, new_id long")
    root = folder(spark, "publish")
    for _ in range(2):
        publish.publish_once(root, ("all", 1), read("base"), read("incoming"), pins, read("gone"), rules, heads, scope=["version"], denied=[])
    return commits.read_committed(spark, root, ("all", 1), "report")


def merge_full(spark, sf_dir):
    out = merge.merged_objects(*_merge_inputs(spark, sf_dir), ["version"], True)
    return out.select("version", "api", "kind", "id", "name", "result", "place")


def merge_incoming_order(spark, sf_dir):
    out = merge.merged_objects(*_merge_inputs(spark, sf_dir), ["version"], False)
    return out.select("version", "api", "kind", "id", "name", "result", "place")


def merge_pin_ops(spark, sf_dir):
    return merge.pin_operations(merge.decided(*_merge_inputs(spark, sf_dir), ["version"]))


def _lists(spark, sf_dir):
    text = """SELECT p_partkey AS k, 'flags:# z:flags.' || (p_partkey % 5) || '?true a:int y:flags.' || (p_partkey % 7) || '?true w:flags2.1?true' AS old_text,
      'flags:# a:' || CASE WHEN p_partkey % 2 = 0 THEN 'Bool' ELSE 'long' END || ' n:flags.' || (p_partkey % 9) || '?true a:flags.' || (p_partkey % 4) || '?true y:string' AS new_text FROM part"""
    rows = B.load(spark, sf_dir, "one AS (SELECT 1 AS x)", text)
    as_list = lambda c: F.transform(F.split(c, " "), lambda x: F.struct(F.substring_index(x, ":", 1).alias("name"), F.substr(x, F.instr(x, ":") + 1).alias("type")))
    return rows.select("k", as_list("old_text").alias("old"), as_list("new_text").alias("new"))


def _text(c):
    return F.trim(D.params_text(c))


def flag_bool_order(spark, sf_dir):
    return _lists(spark, sf_dir).select("k", _text(params.group_flag_bools(F.col("old"))).alias("params"))


def merge_params_same(spark, sf_dir):
    return _lists(spark, sf_dir).select("k", _text(params.merge_params(F.col("old"), F.col("new"), F.lit(True))).alias("params"))


def merge_params_changed(spark, sf_dir):
    return _lists(spark, sf_dir).select("k", _text(params.merge_params(F.col("old"), F.col("new"), F.lit(False))).alias("params"))


#: Three objects share a bare name: one in namespace x and one in z that should have it, one that has it but belongs to namespace y; who comes first changes
#: from group to group, and so does who gets the name. Every fifth group has an object more, which wants the name that one of x frees.
_MISNAMED = """mis AS (SELECT CAST(floor(k / 100.0) AS BIGINT) AS source, k, k % 3 AS role, CASE WHEN k % 7 < 3 THEN 'method' ELSE 'constructor' END AS kind, k * 37 % 101 AS pos, 'b' || CAST(floor(k / 3.0) AS BIGINT) AS bare, res FROM decl),
    shown AS (SELECT *, CASE role WHEN 0 THEN 'x.' || bare WHEN 1 THEN bare ELSE 'z.' || bare END AS name, CASE role WHEN 1 THEN 'y.' || res ELSE res END AS result, CASE role WHEN 1 THEN 'y.' || bare ELSE bare END AS own FROM mis
      UNION ALL SELECT source, k + 1000000, 3, CASE WHEN k % 2 = 0 THEN 'method' ELSE 'constructor' END, pos + 50, bare, 'x.' || res, bare || '_q', 'x.' || res, 'x.' || bare FROM mis WHERE role = 0 AND k % 5 = 0),
    named AS (SELECT source, k, kind, pos, CASE role WHEN 3 THEN 'w.' || bare ELSE name END AS name, result, own FROM shown)"""


def name_repair(spark, sf_dir):
    rows = B.load(spark, sf_dir, f"{B.decl('spark')}, {_MISNAMED}", "SELECT * FROM named")
    params_ = F.array(F.struct(F.lit("size").alias("name"), F.lit("int").alias("type")))
    objects = rows.select("source", F.lit("main").alias("api"), "kind", D.checksum_id(D.declaration_text(F.col("own"), params_, F.col("result"))).alias("id"), "name", "result", params_.alias("params"), "pos")
    return repair.repair_names(objects, ["source"]).select("source", "kind", "pos", "id", "name", "result", "repaired")


#: Years as layers of one snapshot, several of them as one layer, some as layer 0; some results are X and t, some methods have a namespace.
_LAYERS = """lay AS (SELECT api, kind, id, pos, CASE WHEN pos % 4 = 0 THEN 'ns' || (pos % 9) || '.' || name ELSE name END AS name, CASE version % 3 WHEN 0 THEN 7 WHEN 1 THEN 0 ELSE 9 END AS layer, 5 AS own_layer, version,
      CASE pos % 50 WHEN 0 THEN 'X' WHEN 1 THEN 'Vector t' ELSE result END AS result FROM snap)"""


def _layered(spark, sf_dir):
    B.snapshots(spark, sf_dir).createOrReplaceTempView("sw_snap")
    return spark.sql(f"WITH snap AS (SELECT * FROM sw_snap), {_LAYERS.replace('(SELECT ', '(SELECT params, ', 1)} SELECT * FROM lay")


def render_groups(spark, sf_dir):
    return render.rendered_lines(_layered(spark, sf_dir), ["api"], "own_layer")


def render_text(spark, sf_dir):
    return render.rendered_text(_layered(spark, sf_dir), ["api"], "own_layer")


def snapshot_roundtrip(spark, sf_dir):
    """All years saved and loaded again."""
    path = folder(spark, "snapshots")
    state.save_snapshot(B.snapshots(spark, sf_dir), path, ["version"])
    out = state.load_snapshot(spark, path, ["version"])
    return out.select("version", "api", "kind", "id", "name", "result", "position", F.size("params").alias("n_params"), F.length(D.params_text(F.col("params"))).alias("params_chars"))


def _roles(snap):
    """Two years have a role, the others none."""
    role = F.when(F.col("version") == 1998, "stable").when(F.col("version") == 2000, "preview")
    return snap.select("version").distinct().withColumn("role", role)


def snapshot_of_role(spark, sf_dir):
    path, snap = folder(spark, "snapshots"), B.snapshots(spark, sf_dir)
    state.save_snapshot(snap, path, ["version"])
    out = state.load_role(spark, path, _roles(snap), "preview", ["version"])
    return out.select("version", "api", "kind", "id", "name", "position", F.size("params").alias("n_params"))


def import_summary(spark, sf_dir):
    """Counts of the snapshots that are kept because they have a role."""
    snap = B.snapshots(spark, sf_dir)
    return state.import_summary(state.without_unreferenced(snap, _roles(snap), ["version"]), ["version"])


def point_lookup(spark, sf_dir):
    wanted = B.load(spark, sf_dir, _PINS, "SELECT DISTINCT os, name FROM ops")
    return state.lookup(B.load(spark, sf_dir, _PINS, "SELECT * FROM pins"), wanted, ["os", "name"])


def flag_types(spark, sf_dir):
    rows = B.load(spark, sf_dir, "one AS (SELECT 1 AS x)", "SELECT p_partkey AS k, p_type AS type FROM part")
    word = F.concat(F.lit("flags"), F.when(F.col("k") % 3 == 0, "").otherwise((F.col("k") % 3).cast("string")))
    return rows.select("k", ids.flag_type(word, F.col("k") % 32, F.col("type")).alias("type"))


def source_names(spark, sf_dir):
    rows = B.load(spark, sf_dir, "one AS (SELECT 1 AS x)", "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'tdesktop' WHEN 1 THEN 'android' WHEN 2 THEN 'ios' WHEN 3 THEN 'tdlib' ELSE 'web' END AS source, p_size || '.' || (p_partkey % 9) AS version FROM part")
    c = F.col("source")
    return rows.select("k", naming.source_name(c).alias("name"), naming.source_name(c, True).alias("short"), naming.shown_version(c, F.col("version"), F.col("k")).alias("version"))


_FNS = (
    snapshot_diff, param_diff, diff_all_years, diff_stats, publish_gate, changelog_lines, page_items, context_topk, report_links, removed_ids, removed_ids_except, release_catalog, recent_trim, role_rotate, baseline_pick,
    canonical_index, canonical_apply, rename_propagate, override_apply, override_stale, deprecation_filter, api_split, pins_apply, state_writes, newer_upstream, merge_full, merge_incoming_order, merge_pin_ops, publish_report, pins_store,
    flag_bool_order, merge_params_same, merge_params_changed, name_repair, render_groups, render_text, snapshot_roundtrip, snapshot_of_role, import_summary, point_lookup, flag_types, source_names,
)
QUERIES = {f.__name__: f for f in _FNS}

_S = f"WITH {B.SNAP}"
_DIFF = f"""{_S}, old_p AS (SELECT version, pk, pname, ptype FROM sold), pairs AS (SELECT a.version + 1 AS version FROM (SELECT DISTINCT version FROM snap) a JOIN (SELECT DISTINCT version FROM snap) b ON b.version = a.version + 1),
    o AS (SELECT snap.* REPLACE (version + 1 AS version) FROM snap WHERE version + 1 IN (SELECT version FROM pairs)), n AS (SELECT * FROM snap WHERE version IN (SELECT version FROM pairs)),
    j AS (SELECT coalesce(n.version, o.version) AS version, coalesce(n.api, o.api) AS api, coalesce(n.kind, o.kind) AS kind, coalesce(n.name, o.name) AS name, coalesce(n.id, o.id) AS id, coalesce(n.pos, o.pos) AS pos, o.name AS oname, n.name AS nname, o.result AS ores, n.result AS nres
      FROM o FULL JOIN n ON o.version = n.version AND o.api = n.api AND o.kind = n.kind AND o.name = n.name),
    pj AS (SELECT coalesce(b.version, a.version + 1) AS version, coalesce(a.pk, b.pk) AS pos, coalesce(a.pname, b.pname) AS p, a.ptype AS ot, b.ptype AS nt FROM sold a FULL JOIN sold b ON a.version + 1 = b.version AND a.pk = b.pk AND a.pname = b.pname),
    pc AS (SELECT version, pos, count(*) FILTER (ot IS NULL) AS n_new, count(*) FILTER (nt IS NULL) AS n_removed, count(*) FILTER (ot <> nt) AS n_changed,
      coalesce(string_agg(p, ',' ORDER BY p) FILTER (ot IS NULL), '') AS new_fields, coalesce(string_agg(p, ',' ORDER BY p) FILTER (nt IS NULL), '') AS removed_fields, coalesce(string_agg(p || ':' || ot || '>' || nt, ',' ORDER BY p) FILTER (ot <> nt), '') AS changed_fields,
      string_agg(p, ', ' ORDER BY p) FILTER (ot IS NULL) AS a_txt, string_agg(p, ', ' ORDER BY p) FILTER (nt IS NULL) AS r_txt, string_agg(p || ': ' || ot || ' -> ' || nt, '; ' ORDER BY p) FILTER (ot <> nt) AS c_txt, string_agg(p || ' from ' || ot || ' to ' || nt, ', ' ORDER BY p) FILTER (ot <> nt) AS f_txt FROM pj GROUP BY 1, 2),
    d0 AS (SELECT j.*, CASE WHEN oname IS NULL THEN 'new' WHEN nname IS NULL THEN 'deleted' WHEN ores <> nres OR n_new + n_removed + n_changed > 0 THEN 'changed' END AS change, pc.* EXCLUDE (version, pos) FROM j LEFT JOIN pc USING (version, pos)),
    d AS (SELECT * REPLACE (CASE WHEN change = 'changed' THEN n_new END AS n_new, CASE WHEN change = 'changed' THEN n_removed END AS n_removed, CASE WHEN change = 'changed' THEN n_changed END AS n_changed),
      CASE WHEN change = 'changed' AND ores <> nres THEN ores END AS old_result, CASE WHEN change = 'changed' AND ores <> nres THEN nres END AS new_result FROM d0 WHERE change IS NOT NULL)"""
_R = f"WITH {B.RELEASED}"
_EMPTY = "coalesce(len(list_filter(string_split(x, ' '), lambda y: y <> '')), 0)"
_EXTRA = {
    "snapshot_of_role": _S + """, p AS (SELECT version, pk AS pos, count(*) AS c FROM sold GROUP BY 1, 2) SELECT version, api, kind, id, name, row_number() OVER (PARTITION BY version ORDER BY CASE api WHEN 'main' THEN 1 ELSE 2 END, CASE kind WHEN 'constructor' THEN 1 ELSE 2 END, pos) - 1 AS position, c AS n_params FROM snap JOIN p USING (version, pos) WHERE version = 2000""",
    "import_summary": _S + """ SELECT version, count(*) FILTER (api = 'main' AND kind = 'constructor') AS main_constructors, count(*) FILTER (api = 'main' AND kind = 'method') AS main_methods, count(*) FILTER (api = 'e2e' AND kind = 'constructor') AS e2e_constructors, count(*) FILTER (api = 'e2e' AND kind = 'method') AS e2e_methods
        FROM snap WHERE version IN (1998, 2000) GROUP BY version""",
    "point_lookup": f"WITH {_PINS} SELECT o.os, o.name, p.old_id, p.new_id, p.name IS NOT NULL AS found FROM (SELECT DISTINCT os, name FROM ops) o LEFT JOIN pins p ON p.os = o.os AND p.name = o.name",
    "flag_types": "SELECT p_partkey AS k, 'flags' || CASE p_partkey % 3 WHEN 0 THEN '' ELSE (p_partkey % 3)::VARCHAR END || '.' || (p_partkey % 32) || '?' || p_type AS type FROM part",
    "source_names": """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'Telegram Desktop' WHEN 1 THEN 'Telegram for Android' WHEN 2 THEN 'Telegram for iOS' WHEN 3 THEN 'TDLib' ELSE '' END AS name, CASE p_partkey % 5 WHEN 0 THEN 'TDesktop' WHEN 1 THEN 'Android' WHEN 2 THEN 'iOS' WHEN 3 THEN 'TDLib' ELSE '' END AS short,
        CASE WHEN p_partkey % 5 IN (0, 3) THEN p_size || '.' || (p_partkey % 9) WHEN p_partkey % 5 IN (1, 2) THEN p_size || '.' || (p_partkey % 9) || ' (' || p_partkey || ')' ELSE '' END AS version FROM part""",
}
_RENDERED = f"""{_LAYERS}, p AS (SELECT version, pk AS pos, string_agg(' ' || pname || ':' || ptype, '' ORDER BY pname) AS txt FROM sold GROUP BY 1, 2),
    l AS (SELECT lay.* REPLACE (CASE layer WHEN 0 THEN 5 ELSE layer END AS layer), p.txt, CASE WHEN result = 'X' THEN 'X' WHEN kind = 'method' THEN split_part(name, '.', 1) ELSE result END AS grp FROM lay JOIN p USING (version, pos)),
    g AS (SELECT *, min(pos) OVER (PARTITION BY api, kind, layer, grp) AS group_rank, max(layer) OVER (PARTITION BY api, kind, name) AS top FROM l),
    lined AS (SELECT api, kind, layer, group_rank, pos, name || CASE WHEN layer < top THEN layer::VARCHAR ELSE '' END || '#' || lower(to_hex(id)) || CASE result WHEN 'X' THEN ' {{X:Type}}' WHEN 'Vector t' THEN ' {{t:Type}} # [ t ]' ELSE '' END || txt || ' = ' || result || ';' AS line FROM g)"""
ORACLES = {
    "snapshot_diff": _DIFF + " SELECT version, api, kind, name, id, change, old_result, new_result FROM d",
    "param_diff": _DIFF + " SELECT version, name, new_fields, removed_fields, changed_fields FROM d WHERE change = 'changed'",
    "diff_all_years": _DIFF + " SELECT version, api, kind, name, id, change, n_new, n_removed, n_changed, old_result, new_result FROM d",
    "diff_stats": _DIFF + """ SELECT version, CASE WHEN grouping(api) = 1 THEN 'all' ELSE api END AS api, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) FILTER (change = 'new') AS additions, count(*) FILTER (change = 'changed') AS changes, count(*) FILTER (change = 'deleted') AS deletions
        FROM d GROUP BY GROUPING SETS ((version, api, kind), (version, api), (version))""",
    "publish_gate": _DIFF + " SELECT version, 5 AS layer, 3 AS prev_layer, count(*) AS differences FROM d WHERE change <> 'deleted' AND version % 3 <> 0 GROUP BY version",
    "changelog_lines": _DIFF + """, txt AS (SELECT version, pk AS pos, string_agg(' ' || pname || ':' || ptype, '' ORDER BY pname) AS txt FROM sold GROUP BY 1, 2), full_ AS (SELECT d.*, coalesce(a.txt, b.txt) AS txt, coalesce(nres, ores) AS res FROM d LEFT JOIN txt a ON change <> 'deleted' AND a.version = d.version AND a.pos = d.pos LEFT JOIN txt b ON change = 'deleted' AND b.version = d.version - 1 AND b.pos = d.pos)
        SELECT version, CASE change WHEN 'new' THEN 'added' WHEN 'deleted' THEN 'removed' ELSE 'changed' END AS section, CASE api WHEN 'e2e' THEN '[e2e] ' ELSE '' END || name || '#' || lower(to_hex(id)) || txt || ' = ' || res || ';' || CASE WHEN change = 'changed' THEN ' (' || concat_ws('; ', 'added: ' || a_txt, 'removed: ' || r_txt, c_txt, 'returns: ' || old_result || ' -> ' || new_result) || ')' ELSE '' END AS line FROM full_""",
    "page_items": _DIFF + """ SELECT version, api, kind, CASE change WHEN 'new' THEN 'added' ELSE 'removed' END AS section, 'object' AS item, name, '' AS text FROM d WHERE change <> 'changed'
        UNION ALL SELECT version, api, kind, 'changed', 'fields', name, concat_ws('; ', 'added ' || a_txt, 'removed ' || r_txt, 'changed ' || f_txt) FROM d WHERE change = 'changed' AND n_new + n_removed + n_changed > 0
        UNION ALL SELECT version, api, kind, 'changed', 'result', name, 'from ' || old_result || ' to ' || new_result FROM d WHERE new_result IS NOT NULL""",
    "context_topk": f"""{_S}, {_CONTEXT}, pairs AS (SELECT a.version FROM (SELECT DISTINCT version FROM snap) a JOIN (SELECT DISTINCT version FROM snap) b ON b.version = a.version - 1), c AS (SELECT * REPLACE (result || '_' || (pos % 7) AS result) FROM snap),
        moved AS (SELECT DISTINCT coalesce(b.version, a.version + 1) AS version, coalesce(a.pos, b.pos) AS pos FROM cpar a FULL JOIN cpar b ON a.version + 1 = b.version AND a.pos = b.pos AND a.pname = b.pname WHERE a.ptype IS DISTINCT FROM b.ptype),
        dif AS (SELECT n.* FROM c n JOIN pairs USING (version) LEFT JOIN c o ON o.version = n.version - 1 AND o.pos = n.pos LEFT JOIN moved m ON m.version = n.version AND m.pos = n.pos WHERE o.pos IS NULL OR o.result <> n.result OR m.pos IS NOT NULL),
        use_ AS (SELECT version, api, kind, pos, 0 AS i, result AS t FROM dif UNION ALL SELECT d.version, d.api, d.kind, d.pos, row_number() OVER (PARTITION BY d.version, d.pos ORDER BY p.pname), p.ptype FROM dif d JOIN cpar p USING (version, pos)),
        seq AS (SELECT *, CASE api WHEN 'main' THEN 1 ELSE 2 END AS ka, CASE kind WHEN 'method' THEN 1 ELSE 2 END AS kk, regexp_replace(regexp_replace(regexp_replace(t, '^flags\\d*\\.\\d+\\?', ''), '^Vector<(.*)>$', '\\1'), '^[%!]+', '') AS result FROM use_),
        ord AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY ka, kk, pos, i) AS at_ FROM seq WHERE result <> 'int'), first_ AS (SELECT version, result, min(at_) AS at_ FROM ord GROUP BY 1, 2),
        objs AS (SELECT *, row_number() OVER (PARTITION BY version, result ORDER BY CASE api WHEN 'main' THEN 1 ELSE 2 END, CASE kind WHEN 'constructor' THEN 1 ELSE 2 END, pos) AS turn FROM c JOIN pairs USING (version)), hit AS (SELECT o.*, f.at_ FROM objs o JOIN first_ f USING (version, result) WHERE turn <= 4),
        per AS (SELECT version, result, coalesce(sum(count(*)) OVER (PARTITION BY version ORDER BY min(at_) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hit GROUP BY version, result)
        SELECT version, result, (before + turn - 1)::BIGINT AS place, name FROM hit JOIN per USING (version, result) WHERE before < 400""",
    "report_links": _DIFF + """ SELECT d.version, d.api, d.kind, d.name, d.change, 'https://example.org/' || l.id AS link, 'about ' || t.name AS description FROM d LEFT JOIN (SELECT version, api, kind, id FROM n WHERE id % 2 = 0) l ON l.version = d.version AND l.api = d.api AND l.kind = d.kind AND l.id = d.id
        LEFT JOIN (SELECT name FROM n WHERE version = 2000 AND pos % 3 = 0) t ON t.name = d.name""",
    "removed_ids": _R + """, steps AS (SELECT layer, lead(layer) OVER (ORDER BY layer) AS next FROM (SELECT DISTINCT layer FROM released)) SELECT DISTINCT r.id FROM released r JOIN steps s ON r.layer = s.layer WHERE s.next IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM released n WHERE n.layer = s.next AND n.id = r.id) AND NOT EXISTS (SELECT 1 FROM released n WHERE n.layer = (SELECT max(layer) FROM released) AND n.id = r.id)""",
    "removed_ids_except": _R + " SELECT id FROM released EXCEPT SELECT id FROM released WHERE layer = (SELECT max(layer) FROM released)",
    "release_catalog": _R + " SELECT layer, count(DISTINCT id) AS ids, (SELECT coalesce(max(layer), 0) FROM released) AS latest, FALSE AS first_run, 1996 < (SELECT max(layer) FROM released) AND layer >= 1996 AS backfill FROM released GROUP BY layer",
    "recent_trim": "SELECT source, layer FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seen DESC, layer DESC) AS n FROM (SELECT o_custkey AS source, CAST(year(o_orderdate) AS INT) AS layer, max(o_orderdate) AS seen FROM orders GROUP BY 1, 2)) WHERE n <= 2",
    "role_rotate": _R + """, s AS (SELECT o_custkey AS source, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders), r AS (SELECT id AS source, count(DISTINCT layer) AS c FROM released WHERE layer >= 2000 GROUP BY id)
        SELECT s.source, s.id, CASE WHEN n = 1 THEN 'preview' WHEN n = 2 AND coalesce(c, 0) > 1 THEN 'stable' WHEN n = 3 AND coalesce(c, 0) <= 1 THEN 'stable' END AS role FROM s LEFT JOIN r USING (source)""",
    "baseline_pick": _R + """, h AS (SELECT id AS source, max(layer) AS layer, min(layer) AS low FROM released GROUP BY id) SELECT source, layer, CASE WHEN layer >= 1999 AND source % 3 <> 0 THEN low ELSE layer - 1 END AS baseline FROM h""",
    "canonical_index": f"WITH {_TYPES} SELECT scope, lower(regexp_extract(type, '([^.]*)$', 1)) AS low, min(type) AS spelling FROM types GROUP BY 1, 2 HAVING count(DISTINCT type) = 1",
    "canonical_apply": f"""WITH {_TYPES}, idx AS (SELECT scope, lower(regexp_extract(type, '([^.]*)$', 1)) AS low, min(type) AS spelling FROM types GROUP BY 1, 2 HAVING count(DISTINCT type) = 1),
        pred AS (SELECT scope, lower(name) AS low, min(result) AS spelling FROM objects o WHERE kind = 'constructor' AND NOT EXISTS (SELECT 1 FROM types t WHERE t.scope = o.scope AND lower(regexp_extract(t.type, '([^.]*)$', 1)) = lower(o.name)) GROUP BY 1, 2 HAVING count(DISTINCT result) = 1),
        u AS (SELECT scope, k, type AS t0, CASE k % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'flags.2?Vector<' || lower(type) || '>' WHEN 2 THEN 'Vector<Vector<' || upper(type) || '>>' WHEN 3 THEN 'x.unknown' || k WHEN 4 THEN 'y.' || upper(nm) ELSE lower(type) END AS type,
          CASE k % 6 WHEN 0 THEN 'int' WHEN 2 THEN upper(type) WHEN 3 THEN 'x.unknown' || k WHEN 4 THEN 'y.' || upper(nm) ELSE lower(type) END AS bare FROM types),
        s AS (SELECT u.*, coalesce(idx.spelling, pred.spelling, bare) AS c0 FROM u LEFT JOIN idx ON idx.scope = u.scope AND idx.low = lower(regexp_extract(bare, '([^.]*)$', 1)) LEFT JOIN pred ON pred.scope = u.scope AND pred.low = lower(regexp_extract(bare, '([^.]*)$', 1))),
        f AS (SELECT *, CASE WHEN bare = 'int' THEN 'int' WHEN contains(c0, '.') THEN split_part(c0, '.', 1) || '.' || upper(split_part(c0, '.', 2)[1]) || split_part(c0, '.', 2)[2:] ELSE upper(c0[1]) || c0[2:] END AS c FROM s)
        SELECT scope, k, type, CASE k % 6 WHEN 1 THEN 'flags.2?Vector<' || c || '>' WHEN 2 THEN 'Vector<Vector<' || c || '>>' ELSE c END AS canonical FROM f""",
    "rename_propagate": f"{_S}, {_RENAMES}, np AS (SELECT version, pk AS pos, string_agg(pname || ':' || ptype, ' ' ORDER BY pname) AS main_, string_agg(pname || ':' || CASE ptype WHEN 'A' THEN 'olda' ELSE ptype END, ' ' ORDER BY pname) AS back FROM sold GROUP BY 1, 2) SELECT version, api, name, coalesce(CASE WHEN api = 'main' THEN old_name END, result) AS result, CASE WHEN api = 'main' THEN back ELSE main_ END AS params FROM snap JOIN np USING (version, pos) LEFT JOIN renames ON new_name = result",
    "override_apply": f"{_S}, {_RULES}, np AS (SELECT version, pk AS pos, count(*) AS c FROM sold GROUP BY 1, 2) SELECT s.version, s.id, coalesce(r.name, s.name) AS name, coalesce(r.result, s.result) AS result, r.id IS NOT NULL AS overridden, CASE WHEN r.id IS NULL THEN c ELSE 0 END AS n_params FROM snap s JOIN np USING (version, pos) LEFT JOIN rules r ON r.id = s.id",
    "override_stale": f"{_S}, {_RULES} SELECT id, name FROM rules WHERE id NOT IN (SELECT id FROM snap)",
    "deprecation_filter": f"{_S}, {B.RELEASED}, gone AS (SELECT id FROM released EXCEPT SELECT id FROM released WHERE layer = (SELECT max(layer) FROM released)) SELECT version, api, id, name FROM snap WHERE api <> 'main' OR (name NOT IN ('small_ring0', 'red_widget1') AND id NOT IN (SELECT id FROM gone))",
    "api_split": "SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 'decryptedMessage' || p_partkey ELSE replace(p_name, ' ', '.') END AS name, CASE WHEN p_partkey % 6 = 0 OR p_partkey % 10 = 0 THEN 'e2e' ELSE 'main' END AS api FROM part",
    "pins_apply": f"WITH {_PINS}, kept AS (SELECT p.* FROM pins p WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.op = 'delete' AND o.os = p.os AND o.name = p.name)) SELECT os, name, old_id, new_id FROM (SELECT *, row_number() OVER (PARTITION BY os, name ORDER BY seq DESC) AS n FROM (SELECT *, -1 AS seq FROM kept UNION ALL SELECT os, name, old_id, new_id, seq FROM ops WHERE op = 'create')) WHERE n = 1",
    "state_writes": _R + " SELECT DISTINCT layer, id FROM released WHERE id NOT IN (SELECT id FROM released WHERE id % 5 = 0)",
    "newer_upstream": "WITH v AS (SELECT o_custkey AS scope, CASE WHEN o_orderkey % 2 = 0 THEN 'desktop' ELSE 'lib' END AS source, max(CAST(year(o_orderdate) AS INT)) AS layer FROM orders GROUP BY 1, 2) SELECT scope, source, layer FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY layer DESC, source) AS n FROM v) WHERE n = 1",
    "flag_bool_order": """WITH x AS (SELECT p_partkey AS k, p_partkey % 5 AS z, p_partkey % 7 AS y FROM part) SELECT k, 'flags:# ' || CASE WHEN z <= y THEN 'z:flags.' || z || '?true y:flags.' || y || '?true' ELSE 'y:flags.' || y || '?true z:flags.' || z || '?true' END || ' a:int w:flags2.1?true' AS params FROM x""",
    "merge_params_same": """WITH x AS (SELECT p_partkey AS k, p_partkey % 5 AS z, p_partkey % 7 AS y, p_partkey % 9 AS n FROM part), u AS (SELECT k, z AS bit, 1 AS i, 'z' AS nm FROM x UNION ALL SELECT k, y, 3, 'y' FROM x UNION ALL SELECT k, n, 9, 'n' FROM x WHERE n <> z AND n <> y)
        SELECT k, 'flags:# ' || string_agg(nm || ':flags.' || bit || '?true', ' ' ORDER BY bit, i) || ' a:int w:flags2.1?true' AS params FROM u GROUP BY k""",
    "merge_params_changed": """SELECT p_partkey AS k, 'flags:# a:' || CASE WHEN p_partkey % 2 = 0 THEN 'Bool' ELSE 'flags.' || (p_partkey % 4) || '?true' END || ' n:flags.' || (p_partkey % 9) || '?true y:string' AS params FROM part""",
    "name_repair": f"""WITH RECURSIVE {B.DUCK_CRC_TABLE}, {B.decl('duckdb')}, {_MISNAMED}, objs AS (SELECT source, kind, pos, k, name, result, {B.duck_crc("(own || ' size:int = ' || result)")} AS id FROM named, crc_table),
        parts AS (SELECT *, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE '' END AS ns, regexp_extract(name, '([^.]*)$', 1) AS nb, CASE WHEN contains(result, '.') THEN split_part(result, '.', 1) ELSE '' END AS rs, regexp_extract(result, '([^.]*)$', 1) AS rb FROM objs),
        vars AS (SELECT source, kind, pos, k, id, name, result, unnest(list_transform(list_concat([{{'n': nb, 'r': result}}, {{'n': name, 'r': rb}}, {{'n': nb, 'r': rb}}], CASE WHEN ns <> '' THEN [{{'n': nb, 'r': ns || '.' || rb}}, {{'n': ns || '.' || nb, 'r': rb}}, {{'n': ns || '.' || nb, 'r': ns || '.' || rb}}] ELSE [] END,
          CASE WHEN rs <> '' THEN [{{'n': nb, 'r': rs || '.' || rb}}, {{'n': rs || '.' || nb, 'r': rb}}, {{'n': rs || '.' || nb, 'r': rs || '.' || rb}}] ELSE [] END), lambda v, i: {{'v': v, 'i': i}})) AS u FROM parts),
        hits AS (SELECT source, kind, pos, k, id, name, result, list({{'n': u.v.n, 'r': u.v.r}} ORDER BY u.i) AS c FROM vars, crc_table WHERE id = {B.duck_crc("(u.v.n || ' size:int = ' || u.v.r)")} GROUP BY ALL),
        todo AS (SELECT h.*, row_number() OVER (PARTITION BY h.source ORDER BY h.kind, h.pos, h.id, h.name) AS rn FROM hits h, crc_table WHERE h.id <> {B.duck_crc("(h.name || ' size:int = ' || h.result)")}),
        walk AS (SELECT source, 0::BIGINT AS rn, list(DISTINCT name) AS taken, NULL::BIGINT AS k, NULL::STRUCT(n VARCHAR, r VARCHAR) AS got FROM objs GROUP BY source
          UNION ALL SELECT w.source, t.rn, CASE WHEN got_ IS NULL OR got_.n = t.name THEN w.taken ELSE list_append(list_filter(w.taken, lambda x: x <> t.name), got_.n) END, t.k, got_
            FROM walk w JOIN todo t ON t.source = w.source AND t.rn = w.rn + 1, LATERAL (SELECT list_filter(t.c, lambda v: v.n = t.name OR NOT list_contains(w.taken, v.n))[1]) l(got_))
        SELECT o.source, o.kind, o.pos, o.id, coalesce(w.got.n, o.name) AS name, coalesce(w.got.r, o.result) AS result, w.got IS NOT NULL AS repaired FROM objs o LEFT JOIN walk w ON w.source = o.source AND w.k = o.k""",
    "render_groups": f"""{_S}, {_RENDERED} SELECT api, kind, layer, group_rank, pos, line FROM lined""",
    "render_text": f"""{_S}, {_RENDERED}, t1 AS (SELECT api, kind, layer, group_rank, string_agg(line, chr(10) ORDER BY pos, line) AS txt FROM lined GROUP BY ALL), t2 AS (SELECT api, kind, layer, string_agg(txt, chr(10) || chr(10) ORDER BY group_rank) AS txt FROM t1 GROUP BY ALL),
        t3 AS (SELECT *, count(*) OVER (PARTITION BY api, kind) AS n FROM t2) SELECT api, kind, string_agg(CASE WHEN n > 1 THEN '// layer ' || layer || chr(10) ELSE '' END || txt, chr(10) || chr(10) ORDER BY layer) AS text FROM t3 GROUP BY api, kind""",
    "snapshot_roundtrip": _S + """, p AS (SELECT version, pk AS pos, count(*) AS c, sum(length(pname) + length(ptype) + 2) AS n FROM sold GROUP BY 1, 2) SELECT version, api, kind, id, name, result, row_number() OVER (PARTITION BY version ORDER BY CASE api WHEN 'main' THEN 1 ELSE 2 END, CASE kind WHEN 'constructor' THEN 1 ELSE 2 END, pos) - 1 AS position, c AS n_params, n AS params_chars FROM snap JOIN p USING (version, pos)""",
}

#: The fold row by row: what an object is after each of its rows, in the order of these.
_DECIDED = f"""WITH RECURSIVE {_MERGE}, r0 AS (SELECT i.*, coalesce(a.id, b.id) AS b_id, coalesce(a.name, b.name) AS b_name, coalesce(a.result, b.result) AS b_result, p.old_id AS po, p.new_id AS pn, g.id IS NOT NULL AS gone
      FROM incoming i LEFT JOIN base a ON a.version = i.version AND a.api = i.api AND a.kind = i.kind AND a.id = i.id LEFT JOIN base b ON b.version = i.version AND b.api = i.api AND b.kind = i.kind AND b.name = i.name LEFT JOIN pin p ON p.os = i.os AND p.name = i.name LEFT JOIN (SELECT DISTINCT id FROM gone) g ON g.id = i.id),
    r1 AS (SELECT *, coalesce(b_id, id) AS target, b_id IS NOT NULL AS old FROM r0), r AS (SELECT *, row_number() OVER w AS rn, first_value(coalesce(b_name, name)) OVER w AS own_name FROM r1 WINDOW w AS (PARTITION BY version, api, kind, target ORDER BY pos, id, name)),
    st AS (SELECT version, api, kind, target, old, own_name, CASE WHEN old THEN 0 ELSE 1 END AS rn, coalesce(b_id, id) AS id, coalesce(b_result, result) AS result, CASE WHEN NOT old THEN pos END AS in_pos, []::STRUCT(name VARCHAR, old_id BIGINT, new_id BIGINT)[] AS pins, []::STRUCT(os VARCHAR, name VARCHAR, op VARCHAR, old_id BIGINT, new_id BIGINT)[] AS ops FROM r WHERE rn = 1
      UNION ALL SELECT version, api, kind, target, old, own_name, rn + 1, CASE WHEN skip THEN id ELSE x_id END, CASE WHEN NOT skip AND kind = 'method' AND regexp_matches(x_result, '^[A-Z]') AND lower(x_result) <> lower(result) THEN x_result ELSE result END, CASE WHEN skip THEN in_pos ELSE coalesce(in_pos, x_pos) END,
          CASE WHEN stale THEN list_append(pins, {{'name': x_name, 'old_id': NULL, 'new_id': NULL}}) WHEN makes THEN list_append(pins, {{'name': x_name, 'old_id': x_id, 'new_id': id}}) ELSE pins END,
          CASE WHEN stale THEN list_append(ops, {{'os': os, 'name': x_name, 'op': 'delete', 'old_id': NULL, 'new_id': NULL}}) WHEN makes THEN list_append(ops, {{'os': os, 'name': x_name, 'op': 'create', 'old_id': x_id, 'new_id': id}}) ELSE ops END
        FROM (SELECT *, po IS NOT NULL AND pn <> id AS stale, po IS NULL AND id <> x_id AND same_layer AS makes, (po IS NOT NULL AND pn = id AND po = x_id) OR (po IS NULL AND id <> x_id AND (same_layer OR gone)) AS skip
          FROM (SELECT s.*, x.id AS x_id, x.name AS x_name, x.result AS x_result, x.pos AS x_pos, x.os, x.same_layer, x.gone, CASE WHEN len(mine) > 0 THEN mine[-1].old_id ELSE x.po END AS po, CASE WHEN len(mine) > 0 THEN mine[-1].new_id ELSE x.pn END AS pn
            FROM (SELECT st.*, list_filter(st.pins, lambda p: p.name = q.name) AS mine FROM st JOIN r q ON q.version = st.version AND q.api = st.api AND q.kind = st.kind AND q.target = st.target AND q.rn = st.rn + 1) s JOIN r x ON x.version = s.version AND x.api = s.api AND x.kind = s.kind AND x.target = s.target AND x.rn = s.rn + 1))),
    f AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY version, api, kind, target ORDER BY rn DESC) = 1),
    ren AS (SELECT version, api, kind, name AS new_name, max_by(own_name, pos) AS old_name FROM r WHERE own_name <> name GROUP BY ALL)"""
# each list of constructors or methods is merged and renamed by itself; without the base's order its secret objects come first, then the incoming ones
_KEPT = f"""{_DECIDED},
    rows_ AS (SELECT b.version, b.api, b.kind, coalesce(f.id, b.id) AS id, b.name, coalesce(f.result, b.result) AS result, 0 AS new_, '' AS hex_, b.pos, f.in_pos FROM base b LEFT JOIN f ON f.old AND f.version = b.version AND f.api = b.api AND f.kind = b.kind AND f.target = b.id
      UNION ALL SELECT version, api, kind, id, own_name, result, 1, lower(to_hex(target)), in_pos, in_pos FROM f WHERE NOT old),
    named AS (SELECT rows_.* REPLACE (coalesce(ren.old_name, result) AS result) FROM rows_ LEFT JOIN ren ON ren.version = rows_.version AND ren.api = rows_.api AND ren.kind = rows_.kind AND ren.new_name = rows_.result)"""
ORACLES |= _EXTRA | {
    "merge_pin_ops": _DECIDED + " SELECT o.os, o.name, o.op, o.old_id, o.new_id FROM (SELECT version, api, kind, target, unnest(list_transform(ops, lambda o, i: {'o': o, 'last': len(list_filter(ops[i + 1:], lambda q: q.name = o.name)) = 0})) AS u FROM f), LATERAL (SELECT u.o) t(o) WHERE u.last",
    "merge_full": _KEPT + " SELECT version, api, kind, id, name, result, row_number() OVER (PARTITION BY version, api, kind ORDER BY new_, hex_, pos, id) - 1 AS place FROM named",
    "merge_incoming_order": _KEPT + " SELECT version, api, kind, id, name, result, row_number() OVER (PARTITION BY version, api, kind ORDER BY CASE WHEN new_ = 0 AND api = 'e2e' THEN 0 ELSE 1 END, CASE WHEN new_ = 0 AND api = 'e2e' THEN pos ELSE in_pos END, id) - 1 AS place FROM named WHERE in_pos IS NOT NULL OR api = 'e2e'",
}
ORACLES["pins_store"] = ORACLES["pins_apply"]
ORACLES["publish_report"] = f"""WITH {B.SNAP}, {_UPDATE.format(more='')}, np AS (SELECT version, pk AS pos, list(pname || ':' || ptype ORDER BY pname) AS ps FROM sold GROUP BY 1, 2),
    b AS (SELECT base.*, np.ps FROM base JOIN np ON np.version = base.version - 1 AND np.pos = base.pos), i AS (SELECT incoming.*, np.ps FROM incoming JOIN np ON np.version = incoming.version AND np.pos = incoming.pos),
    r AS (SELECT i.*, coalesce(x.id, y.id) AS b_id FROM i LEFT JOIN b x ON x.version = i.version AND x.api = i.api AND x.kind = i.kind AND x.id = i.id LEFT JOIN b y ON y.version = i.version AND y.api = i.api AND y.kind = i.kind AND y.name = i.name),
    m AS (SELECT b.version, b.api, b.kind, b.name, b.pos, coalesce(r.id, b.id) AS id, CASE WHEN r.id IS NOT NULL AND b.kind = 'method' AND lower(r.result) <> lower(b.result) THEN r.result ELSE b.result END AS result, CASE WHEN r.id <> b.id THEN r.ps ELSE b.ps END AS ps
        FROM b LEFT JOIN r ON r.version = b.version AND r.api = b.api AND r.kind = b.kind AND r.b_id = b.id AND NOT (r.id <> r.b_id AND r.id IN (SELECT id FROM gone))
      UNION ALL SELECT version, api, kind, name, pos, id, result, ps FROM r WHERE b_id IS NULL),
    kept AS (SELECT *, row_number() OVER (PARTITION BY version, id ORDER BY CASE api WHEN 'main' THEN 1 ELSE 2 END DESC, CASE kind WHEN 'constructor' THEN 1 ELSE 2 END DESC) AS turn FROM m WHERE NOT (api = 'main' AND id IN (SELECT id FROM gone))),
    fixed AS (SELECT k.version, k.api, k.kind, k.id, coalesce(u.name, k.name) AS name, coalesce(u.result, k.result) AS result, CASE WHEN u.id IS NULL THEN k.ps ELSE [] END AS ps, u.id IS NOT NULL AS overridden FROM kept k LEFT JOIN rules u ON u.id = k.id AND k.turn = 1),
    j AS (SELECT f.*, coalesce(x.name, y.name) AS o_name, coalesce(x.result, y.result) AS o_result, coalesce(x.ps, y.ps) AS o_ps FROM fixed f LEFT JOIN b x ON x.version = f.version AND x.api = f.api AND x.kind = f.kind AND x.id = f.id LEFT JOIN b y ON y.version = f.version AND y.api = f.api AND y.kind = f.kind AND y.name = f.name),
    d AS (SELECT version, CASE WHEN o_name IS NULL THEN 'new' WHEN result <> o_result OR ps <> o_ps THEN 'changed' END AS change FROM j UNION ALL SELECT version, 'deleted' FROM b WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.version = b.version AND j.api = b.api AND j.kind = b.kind AND j.o_name = b.name)),
    s AS (SELECT version, count(change) AS differences, count(*) FILTER (change = 'new') AS additions, count(*) FILTER (change = 'changed') AS changes, count(*) FILTER (change = 'deleted') AS deletions FROM d GROUP BY 1),
    sound AS (SELECT * FROM fixed WHERE NOT starts_with(name, '1')), known AS (SELECT DISTINCT version, result FROM sound WHERE kind = 'constructor'),
    p AS (SELECT f.version, count(*) FILTER (f.overridden) AS overridden, sum(CASE WHEN starts_with(f.name, '1') THEN 1 ELSE 1 + len(f.ps) + CASE WHEN k.result IS NULL THEN 1 ELSE 0 END END)::BIGINT AS problems, count(*) FILTER (starts_with(f.name, '1')) AS fatal FROM fixed f LEFT JOIN known k ON k.version = f.version AND k.result = f.result GROUP BY 1)
    SELECT version, CASE WHEN version % 3 = 0 THEN 1 ELSE 5 END AS layer, differences, 0::BIGINT AS repaired, overridden, problems, fatal, version % 3 <> 0 AND fatal = 0 AND differences > 0 AS published, additions, changes, deletions FROM p JOIN s USING (version)"""
