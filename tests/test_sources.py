"""Readers on files of each shape, and the streaming jobs."""

import json

from pyspark.sql import functions as F

from schemawake.sources import manifests as M
from schemawake.sources import readers as R
from schemawake.streaming import incremental as S


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


def test_declarations(spark, tmp_path):
    put(tmp_path / "in" / "a.txt", "boolFalse#bc799737 = Bool;\n---functions---\ninvoke#cb9f372d {X:Type} msg_id:long query:!X = X;\n")
    rows = {r["name"]: r for r in R.read_declarations(spark, str(tmp_path / "in")).collect()}
    assert rows["boolFalse"]["kind"] == "constructor" and rows["invoke"]["kind"] == "method"
    assert [tuple(p) for p in rows["invoke"]["params"]] == [("msg_id", "long"), ("query", "!X")] and rows["invoke"]["result"] == "X"


def test_dump_and_releases(spark, tmp_path):
    dump = {"constructors": [{"id": "-470607587", "predicate": "a", "params": [{"name": "x", "type": "int"}], "type": "T"}], "methods": [{"id": "255", "method": "m", "params": [], "type": "U", "layer": 5}]}
    rows = {r["name"]: r for r in R.read_dump(spark, put(tmp_path / "d.json", dump)).collect()}
    assert rows["a"]["id"] == 0xE3F3191D and rows["a"]["force_secret"] and rows["m"]["kind"] == "method" and rows["m"]["layer"] == 5
    for layer in (1, 2):
        put(tmp_path / "rel" / f"layer={layer}" / "r.json", {"constructors": [{"id": str(layer)}], "methods": [{"id": "-1"}]})
    got = {(r["layer"], r["kind"], r["id"]) for r in R.read_releases(spark, str(tmp_path / "rel")).collect()}
    assert got == {(1, "constructor", 1), (2, "constructor", 2), (1, "method", 4294967295), (2, "method", 4294967295)}


def test_pages_and_manifests(spark, tmp_path):
    link = '<li><a href="?layer={}">'
    pages = spark.createDataFrame([(1, "".join(link.format(i) for i in (9, 12, 14))), (2, link.format(3))], "page_id int, html string")
    assert {(r["layer"], r["latest"]) for r in R.layers_on_page(pages).collect()} == {(12, 14), (14, 14)}
    put(tmp_path / "src" / "v.h", 'AppVersion = 5004003;\nAppVersionStr = "5.4.3";\nconstexpr int32 MTPROTO_LAYER = 200;')
    put(tmp_path / "src" / "c.txt", "project(TDLib VERSION 1.8.46 LANGUAGES CXX)\nproject(Lib VERSION 9)\nthis.layer = 7;")
    rows = sorted((tuple(r)[1:] for r in R.versions_of(R.whole_files(spark, str(tmp_path / "src"))).collect()), key=str)
    assert rows == [(5004003, "5.4.3", None, 200), (None, None, "1.8.46", 7)]
    info = R.read_app_info(spark, put(tmp_path / "app.json", {"version": "11.0", "version_code": 50007, "file_url": "u"})).first()
    assert (info["version_name"], info["version_code"]) == ("11.0", 5000)


def test_saved_state(spark, tmp_path):
    state = {"last_version_code": 7, "recent_layers": [3, 4], "patched_objects": {"ios": {"a": {"old_constructor": "-1", "new_constructor": "5"}}}, "released_layers": {"3": {"constructors": [{"id": "9"}], "methods": []}}}
    one = {"constructors": [{"id": "5", "predicate": "c", "params": [], "type": "T"}], "methods": []}
    state["preview_layer"] = {"layer": 8, "main_api": one, "e2e_api": one}
    raw = spark.read.schema(R.STATE).json(put(tmp_path / "s.json", state), multiLine=True)
    t = R.tables_of_state(raw)
    assert sorted(tuple(r) for r in t["snapshots"].select("role", "snapshot_layer", "api", "name", "force_secret").collect()) == [("preview", 8, "e2e", "c", True), ("preview", 8, "main", "c", False)]
    assert [tuple(r) for r in t["pins"].collect()] == [("ios", "a", 4294967295, 5)]
    assert [tuple(r) for r in t["released"].collect()] == [(3, "constructor", 9)]
    assert sorted(r["layer"] for r in t["recent_layers"].collect()) == [3, 4] and t["watermarks"].first()["last_version_code"] == 7


THROTTLE = [("k", "a", 0), ("k", "a", 1), ("k", "b", 2), ("k", "c", 4), ("k", "c", 9), ("k", "d", 10), ("z", "a", 1), ("k", "d", 25), ("k", "d", 31), ("y", "q", 200)]


def throttle_rows(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, s int").select("key", "value", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))


def shown(df):
    return sorted((r["key"], r["value"], r["at"] - 1000) for r in df.select("key", "value", F.unix_seconds("ts").alias("at")).collect())


def test_throttled_stream_equals_the_batch_and_forgets(spark, tmp_path):
    want = [("k", "a", 0), ("k", "c", 4), ("k", "d", 10), ("k", "d", 31), ("y", "q", 200), ("z", "a", 1)]  # d is told again after 20 s
    everything = throttle_rows(spark, THROTTLE)
    assert shown(S.throttled_values(everything, "key", "value", ["ts"], 3.0, 20.0)) == want
    stream = S.throttled_stream(spark.readStream.schema(everything.schema).parquet(str(tmp_path / "in" / "*")), "key", "ts", "value", 3.0, 20.0, late="60 seconds")
    throttle_rows(spark, THROTTLE[:4]).coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        held = []
        for n, part in enumerate((THROTTLE[4:7], THROTTLE[7:9], THROTTLE[9:], [("x", "w", 400)]), 1):
            q.processAllAvailable()
            throttle_rows(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        q.processAllAvailable()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    assert shown(spark.read.parquet(str(tmp_path / "out")).where("key <> 'x'")) == want
    # k, z and y have left: only what the last key keeps (its value and its timer's two entries) is there
    assert max(held) > held[-1] and held[-1] <= 3


def test_manifest_stream_goes_on_where_it_was(spark, tmp_path):
    def put_version(source, code):
        put(tmp_path / "in" / f"source={source}" / f"code={code}" / "m.json", {"version_name": f"{source}-{code}"})

    fail = []

    def process(batch, number):
        rows = batch.collect()
        if fail:
            raise ValueError("lost")
        put(tmp_path / "out" / f"{number}.json", [[r["source"], r["code"], r["version_name"]] for r in rows])

    def run():
        q = M.manifest_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(process).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        except Exception:
            assert fail
        finally:
            q.stop()

    for source, code in (("a", 9), ("a", 10), ("b", 3)):
        put_version(source, code)
    run()
    put_version("a", 11)
    put_version("c", 1)
    put_version("b", 2)  # below the watermark
    fail.append(True)
    run()
    fail.clear()
    put_version("a", 12)
    run()
    run()
    got = [tuple(r) for p in sorted((tmp_path / "out").iterdir()) for r in json.loads(p.read_text())]
    assert sorted(got) == sorted((s, c, f"{s}-{c}") for s, c in (("a", 9), ("a", 10), ("b", 3), ("a", 11), ("c", 1), ("a", 12)))


def test_batch_throttle(spark):
    rows = [("k", 0), ("k", 2), ("k", 3), ("k", 5), ("k", 6), ("z", 1)]
    df = spark.createDataFrame(rows, "key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r["key"], r["s"]) for r in S.throttled(df, "key", ["ts"], 3.0).collect()) == [("k", 0), ("k", 3), ("k", 6), ("z", 1)]
