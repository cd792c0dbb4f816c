"""Golden cases and invariants of the operators."""

from pyspark.sql import functions as F

from schemawake.operators import canonical, changelog, classes, diff, history, merge, params, parse, publish, state

P = "array<struct<name:string,type:string>>"


def as_params(text):
    return [tuple(x.split(":", 1)) for x in text.split(", ")] if text else []


def objects(spark, rows, kind="constructor"):
    data = [("s", "main", kind, id_, name, 0, result, i, as_params(p)) for i, (name, id_, p, result) in enumerate(rows)]
    return spark.createDataFrame(data, f"source string, api string, kind string, id long, name string, layer int, result string, pos long, params {P}")


def rules(spark, *lines):
    rows = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], "file string, line int, source string")
    return [(r["rule"], r["line"]) for r in parse.problems(rows).orderBy("line", "rule").collect()]


def test_every_rule(spark):
    broken = {"V1": "a#1 x:int = T", "V2": "a#1 x:int;", "V3": "= T;", "V4": "a x:int = T;", "V5": "1a#1 = T;", "V6": "a#xyz = T;", "V7": "a#0 = T;", "V8": "a#1 x: = T;"}
    assert rules(spark, *broken.values()) == [(r, i + 1) for i, r in enumerate(broken)]
    found = rules(spark, "a#1 = T;", "b#1 = T;", "a#2 = T;", "c#3 x:int x:long = T;", "d#4 x:flags.0?int flags:# = T;", "e#5 flags:# x:flags.32?int = T;", "g#6 x:Nope = T;", "boolFalse#bc799738 = Bool;")
    by = {}
    for rule, line in found:
        by.setdefault(rule, []).append(line)
    assert by["V9"] == [2] and by["V10"] == [3] and by["V11"] == [4] and by["V12"] == [5] and by["V13"] == [6] and by["V14"] == [7] and 8 in by["V15"]


def test_sections_and_comments(spark):
    rows = spark.createDataFrame([("f", "//x#ab = T;\na#1 = T;\n---functions---\n\nb#2 q:int = T;")], "file string, text string")
    got = {(r["name"], r["kind"]) for r in parse.parse_lenient(parse.lines_of(rows)).collect()}
    assert got == {("a", "constructor"), ("b", "method")}


def test_diff(spark):
    old = objects(spark, [("a", 1, "x:int, y:long", "T"), ("c", 3, "", "T"), ("r", 4, "k:int", "T")])
    new = objects(spark, [("a", 1, "x:long, z:int", "T"), ("b", 2, "", "T"), ("s", 4, "k:int", "T")])
    got = {r["name"]: r for r in diff.diff_snapshots(old, new, ["source", "api", "kind"]).collect()}
    assert {k: r["change"] for k, r in got.items()} == {"a": "changed", "b": "new", "c": "deleted"}
    assert got["a"]["new_fields"] == ["z"] and got["a"]["removed_fields"] == ["y"] and [tuple(x) for x in got["a"]["changed_fields"]] == [("x", "int", "long")]
    assert diff.diff_snapshots(old, old, ["source", "api", "kind"]).isEmpty()


def test_params(spark):
    def run(how, *lists):
        df = spark.createDataFrame([[as_params(x) for x in lists]], ", ".join(f"p{i} {P}" for i in range(len(lists))))
        return [p["name"] for p in df.select(how(*[F.col(f"p{i}") for i in range(len(lists))]).alias("x")).first()["x"]]

    assert run(params.group_flag_bools, "flags:#, a:int, y:flags.3?true, x:flags.1?true, z:flags2.0?true") == ["flags", "x", "y", "a", "z"]
    assert run(params.merge_same_id, "flags:#, a:int, b:flags.0?true", "c:flags.1?true, d:flags.0?true, e:flags2.0?true") == ["flags", "b", "c", "a"]
    df = spark.createDataFrame([[as_params("a:int, b:Bool, a:long, b:flags.0?true")]], f"p {P}")
    assert [tuple(x) for x in df.select(params.merge_other_id(F.col("p")).alias("x")).first()["x"]] == [("a", "long"), ("b", "Bool")]


def merged(spark, base_order, same):
    base = objects(spark, [("a", 1, "", "T"), ("b", 2, "", "T"), ("c", 3, "", "T")]).drop("layer")
    new = objects(spark, [("a2", 1, "", "T"), ("b", 9, "", "T"), ("d", 8, "", "T")]).drop("layer").withColumns({"os": F.lit("o"), "same_layer": F.lit(same)})
    pins = spark.createDataFrame([], "os string, name string, old_id long, new_id long")
    gone = spark.createDataFrame([], "id long")
    out = merge.merged_objects(base, new, pins, gone, ["source"], base_order)
    ops = merge.pin_operations(merge.decided(base, new, pins, gone, ["source"]))
    return [f"{r['name']}#{r['id']}" for r in out.orderBy("place").collect()], [tuple(r) for r in ops.select("name", "op", "old_id", "new_id").collect()]


def test_merge(spark):
    assert merged(spark, True, False) == (["a#1", "b#9", "c#3", "d#8"], [])
    assert merged(spark, True, True) == (["a#1", "b#2", "c#3", "d#8"], [("b", "create", 9, 2)])
    assert merged(spark, False, False) == (["a#1", "b#9", "d#8"], [])
    assert merged(spark, False, True) == (["a#1", "d#8"], [("b", "create", 9, 2)])


def test_removed_ids(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (4, 1), (4, 2), (4, 4)], "layer int, id long")
    assert [r["id"] for r in history.removed_ids(rows).collect()] == [3]
    assert [r["id"] for r in history.removed_ids_except(rows).collect()] == [3]


def test_canonical(spark):
    index = spark.createDataFrame([("s", "inputpeer", "InputPeer")], "source string, low string, spelling string")
    none = index.where("false")
    types = spark.createDataFrame([("s", t) for t in ("flags.2?Vector<inputpeer>", "foo.bar", "int")], "source string, type string")
    got = {r["type"]: r["canonical"] for r in canonical.canonical_types(types, index, none, ["source"]).collect()}
    assert got == {"flags.2?Vector<inputpeer>": "flags.2?Vector<InputPeer>", "foo.bar": "foo.Bar", "int": "int"}
    two = spark.createDataFrame([("s", "Chat"), ("s", "chat")], "source string, type string")
    assert canonical.spelling_index(two, ["source"]).isEmpty()


def test_save_and_load(spark, tmp_path):
    rows = objects(spark, [("a", 1, "x:int, y:long", "T"), ("c", 3, "", "T")])
    state.save_snapshot(rows, str(tmp_path / "snap"), ["source"])
    back = state.load_snapshot(spark, str(tmp_path / "snap"), ["source"]).orderBy("position").collect()
    assert [(r["name"], [tuple(p) for p in r["params"]]) for r in back] == [("a", [("x", "int"), ("y", "long")]), ("c", [])]


def test_merge_order_and_renames_by_list(spark):
    """Without the base's order its secret objects come first; names are taken back only within their own list."""
    rows = [("s", "e2e", "constructor", 1, "a", "T", 0), ("s", "e2e", "constructor", 2, "b", "T", 1), ("s", "main", "constructor", 3, "c", "T", 0), ("s", "main", "method", 4, "m", "Cnew", 0)]
    base = spark.createDataFrame([(*r, []) for r in rows], f"source string, api string, kind string, id long, name string, result string, pos long, params {P}")
    new = [("s", "e2e", "constructor", 9, "z", "T", 0), ("s", "e2e", "constructor", 1, "a", "T", 1), ("s", "main", "constructor", 3, "Cnew", "T", 0), ("s", "main", "constructor", 5, "d", "Cnew", 1), ("s", "main", "method", 4, "m", "Cnew", 0)]
    incoming = spark.createDataFrame([(*r, []) for r in new], base.schema).withColumns({"os": F.lit("o"), "same_layer": F.lit(False)})
    none = spark.createDataFrame([], "os string, name string, old_id long, new_id long")
    out = merge.merged_objects(base, incoming, none, spark.createDataFrame([], "id long"), ["source"], False).orderBy("api", "kind", "place").collect()
    assert [r["name"] for r in out if r["api"] == "e2e"] == ["a", "b", "z"]
    assert {r["name"]: r["result"] for r in out if r["api"] == "main"} == {"c": "T", "d": "c", "m": "Cnew"}


def test_rename_keeps_params_of_equal_names_apart(spark):
    df = objects(spark, [("a", 1, "x:New", "New"), ("a", 2, "y:int", "T")])
    renames = spark.createDataFrame([("s", "New", "old")], "source string, new_name string, old_name string")
    got = sorted((r["id"], [tuple(p) for p in r["params"]], r["result"]) for r in canonical.propagate_renames(df, renames, ["source"]).collect())
    assert got == [(1, [("x", "old")], "old"), (2, [("y", "int")], "T")]


def test_context_order_cap_and_marks(spark):
    full = objects(spark, [("b1", 1, "", "B"), ("a1", 2, "", "A"), ("a2", 3, "", "A"), ("c1", 4, "", "C")]).withColumn("version", F.lit(1))
    used = [(1, "main", "constructor", "n", "changed", "int", 1, as_params("p:flags.1?vector<!A>, q:B")), (1, "main", "method", "m", "new", "C", 5, as_params("r:X")), (1, "main", "method", "gone", "deleted", "Z", 0, [])]
    diffs = spark.createDataFrame(used, f"version int, api string, kind string, name string, change string, result string, pos long, params {P}")
    lines = lambda most: [r["line"].split("#")[0] for r in changelog.context_rows(full, diffs, ["version"], most=most).orderBy("place").collect()]
    assert lines(400) == ["c1", "a1", "a2", "b1"] and lines(2) == ["c1", "a1", "a2"]


def test_cycles_of_classes_end(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("t", None), ("s", "s")], "class string, parent string")
    got = {(r["class"], r["ancestor"]): r["depth"] for r in classes.ancestors(rows).collect()}
    assert {k: v for k, v in got.items() if k[0] == "x"} == {("x", "x"): 0, ("x", "a"): 1, ("x", "b"): 2, ("x", "c"): 3}
    assert got["a", "c"] == 2 and got["a", "a"] == 0 and got["s", "s"] == 0 and got["t", "t"] == 0 and len(got) == 3 * 3 + 4 + 1 + 1
    chain = spark.createDataFrame([(i, i + 1 if i < 250 else None) for i in range(251)], "class long, parent long")
    deep = classes.ancestors(chain)
    assert deep.count() == 251 * 252 // 2 and deep.where("class = 0").agg(F.max("depth")).first()[0] == 250


def test_publish_run(spark):
    base = objects(spark, [("boolFalse", 0xBC799737, "", "Bool"), ("gone", 7, "", "Bool")]).drop("layer")
    fresh = objects(spark, [("boolFalse", 0xBC799737, "", "Bool"), ("boolTrue", 0x997275B5, "", "Bool")]).drop("layer").withColumns({"os": F.lit("o"), "same_layer": F.lit(False)})
    twice = lambda df: df.unionByName(df.withColumn("source", F.lit("t")))
    bad = fresh.where("name = 'boolTrue'").withColumns({"source": F.lit("t"), "id": F.lit(0x1).cast("long"), "name": F.lit("1bad")})
    heads = spark.createDataFrame([("s", 5, 5), ("t", 5, 5), ("u", 4, 5)], "source string, layer int, prev_layer int")
    more = base.withColumn("source", F.lit("u"))
    none = spark.createDataFrame([], "os string, name string, old_id long, new_id long")
    rules_ = spark.createDataFrame([], f"id long, name string, params {P}, result string")
    removed = spark.createDataFrame([(7,)], "id long")
    out = publish.publish_run(twice(base).unionByName(more), twice(fresh).unionByName(bad).unionByName(fresh.withColumn("source", F.lit("u"))), none, removed, rules_, heads, ["source"], [])
    got = {r["source"]: r for r in out["report"].collect()}
    assert got["s"]["published"] and (got["s"]["additions"], got["s"]["deletions"], got["s"]["fatal"]) == (1, 1, 0)
    assert not got["t"]["published"] and got["t"]["fatal"] >= 1  # a name that starts with a digit
    assert not got["u"]["published"] and got["u"]["fatal"] == 0  # its layer went back
    snaps = spark.createDataFrame([(x, i, r) for x in "st" for i, r in enumerate(("incoming", "preview", "stable"))], "source string, id int, role string")
    recent = spark.createDataFrame([("s", 4), ("s", 5)], "source string, layer int")
    roles = {(r["source"], r["id"]): r["role"] for r in publish.promoted(out["report"], snaps, recent, ["source"]).collect()}
    assert roles == {("s", 0): "preview", ("s", 1): "stable", ("s", 2): None, ("t", 0): "incoming", ("t", 1): "preview", ("t", 2): "stable"}
