import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from routeloom.functions import text as tx
from routeloom.operators import infer, reqlog
from routeloom.sources import files, sinks
from routeloom.streaming import health
from routeloom.streaming.publish import publish_stream, published


def test_jsonl_source(spark, tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text('{"id":"a","q":"x"}\n\n  \n{"id":"b","q":" "}\n{broken\n{"id":"c","q":"z"}\n')
    got = files.jsonl_source(spark, str(p), "id string, q string", ["id", "q"]).orderBy("line_no").collect()
    assert [(r.line_no, r.id, r.missing, r._corrupt is not None) for r in got] == [
        (1, "a", None, False), (4, "b", "q", False), (5, None, None, True), (6, "c", None, False),
    ]


def test_library_shapes(spark, tmp_path):
    one = {"name": "s1", "description": "d1"}
    two = {"name": "s2", "description": "d2"}
    shapes = {
        "grouped": {"categories": [{"name": "c1", "skills": [one, two]}, {"name": "c2", "skills": [{"name": "s1", "description": "later"}]}]},
        "flat": {"skills": [one, two]},
        "bare": [one, two],
    }
    for name, body in shapes.items():
        p = tmp_path / f"{name}.json"
        p.write_text(json.dumps(body, indent=1))
        got = files.library_source(spark, str(p))
        assert rows(got, "ord", "name", "description") == [(1, "s1", "d1"), (2, "s2", "d2")], name
    grouped = files.library_source(spark, str(tmp_path / "grouped.json")).where("name = 's1'").first()
    assert list(grouped.categories) == ["c1", "c2"]
    p = tmp_path / "bad.json"
    p.write_text(json.dumps([{"name": " ", "description": "d"}]))
    with pytest.raises(PySparkException):
        files.library_source(spark, str(p)).collect()


def test_checkpoint_source(spark, tmp_path):
    graph = {
        "checkpoint": "c0", "round": 0, "root_node_names": ["r"],
        "nodes": {
            "r": {"name": "r", "description": "Fits r", "parent_names": [], "child_names": ["k"], "direct_skill_names": ["s1"]},
            "k": {"name": "k", "description": "Fits k", "parent_names": ["r"], "child_names": [], "direct_skill_names": ["s2", "s1"]},
        },
    }
    (tmp_path / "graph.json").write_text(json.dumps(graph, indent=1))
    (tmp_path / "skills.jsonl").write_text('{"name":"s1","description":"d","canonical_document":"x","aliases":["o"]}\n{"name":"s2","description":"e","merged_into":"s1"}\n')
    got = files.checkpoint_source(spark, str(tmp_path / "graph.json"), str(tmp_path / "skills.jsonl"))
    assert rows(got["node"], "ord", "name", "is_root") == [(0, "r", True), (1, "k", False)]
    assert rows(got["edge"], "parent", "child", "pos") == [("r", "k", 0)]
    assert rows(got["member"], "node", "pos", "skill") == [("k", 0, "s2"), ("k", 1, "s1"), ("r", 0, "s1")]
    assert {r.skill: r.merged_into for r in got["skill"].collect()} == {"s1": None, "s2": "s1"}


def test_source_tree(spark, tmp_path):
    def put(path, body="x"):
        p = tmp_path / "tree" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)

    put("0001-site/zz/app.js")
    put("0001-site/a.css")
    put("0001-site/index.html", "<canvas>")
    put("0001-site/node_modules/lib.js")
    put("0001-site/src/dist/out.js")
    put("0001-site/metadata.json")
    put("0001-site/source_card.html")
    put("0001-site/empty.js", "")
    put("0001-site/readme.md")
    put("0001-site-longer/b.js")
    put("notes/c.js")
    got = files.source_tree_scan(spark, str(tmp_path / "tree"))
    mine = got.where("site = '0001-site'").orderBy("pref", "path").collect()
    assert [r.path for r in mine] == ["index.html", "zz/app.js", "a.css"]
    assert mine[0].is_index and mine[0].text == "<canvas>"
    assert rows(files.site_folders(got), "number", "site") == [(1, "0001-site-longer")]


def test_sidecar_metadata(spark):
    status = json.dumps({"project": {"title": "T", "url": "old"}, "download": {"title": "D"}, "other": 1})
    df = spark.createDataFrame([(status, "url: http://x:1\nnoise\nby: me"), (None, None), ("{bad", "a:1")], "s string, u string")
    got = [r[0] for r in df.select(files.sidecar_metadata(F.col("s"), F.col("u"))).collect()]
    assert got == [{"title": "D", "url": "http://x:1", "by": "me"}, {}, {"a": "1"}]


def test_cached_records(spark, tmp_path):
    def put(folder, value):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "result.json").write_text(value if isinstance(value, str) else json.dumps(value, indent=1))

    put("01_caseA", {"case_id": "", "version": 2})
    put("02_x", {"case_id": "caseB", "version": 2})
    put("site-9", {"version": 2})
    put("03_old", {"case_id": "caseC", "version": 1})
    put("04_broken", "{oops")
    pattern = f"{tmp_path}/*/result.json"
    got = files.cached_record_scan(spark, pattern, "case_id string, version int", F.col("version") == 2, "site-")
    assert sorted(r.case_id for r in got.collect()) == ["caseA", "caseB", "site-9"]
    put("05_y", {"case_id": "caseB", "version": 2})
    again = files.cached_record_scan(spark, pattern, "case_id string, version int", F.col("version") == 2, "site-")
    with pytest.raises(PySparkException):
        again.collect()


def test_id_list(spark, tmp_path):
    p = tmp_path / "ids.txt"
    p.write_text("# skip\n12\nname extra\n\n  7\n123456\n")
    got = files.id_list_source(spark, str(p), "site", "5, other")
    assert rows(got, "case_id") == [("name",), ("other",), ("site-0005",), ("site-0007",), ("site-0012",), ("site-123456",)]


def test_provenance(spark, tmp_path):
    p = tmp_path / "sources.json"
    p.write_text(json.dumps({"p1": [{"skill": "a", "case_id": "c1"}, {"skill": "b", "case_id": "c2"}], "p2": []}))
    assert rows(files.provenance_source(spark, str(p)), "case", "pos", "skill") == [("p1", 0, "a"), ("p1", 1, "b")]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "catalog")
    t = spark.range(3).toDF("x")
    assert sinks.latest_version(spark, root) is None
    assert sinks.checkpoint_sink(spark, root, {"t": t}) == 0
    assert sinks.checkpoint_sink(spark, root, {"t": t.where("x > 0")}, t) == 1
    assert sinks.read_checkpoint(spark, root, ["t"])["t"].count() == 2
    assert sinks.read_checkpoint(spark, root, ["t"], 0)["t"].count() == 3
    assert [(r.checkpoint, r.from_checkpoint, r.edits) for r in sinks.edit_history(spark, root).collect()] == [
        ("query_induced_round0", None, 0), ("query_induced_round1", "query_induced_round0", 3),
    ]


def test_split_and_summary_sinks(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(2, "b"), (1, "a")], "ord int, q string")
    sinks.publish_split(df, df.drop("q"), out)
    assert [r.q for r in spark.read.json(f"{out}/expanded").collect()] == ["a", "b"]
    states = spark.createDataFrame([(1, "done"), (2, "done"), (3, None), (4, "new")], "id int, state string")
    sinks.run_summary("stage", states, "state", f"{out}/summary", {"last": F.max("id")})
    told = spark.read.json(f"{out}/summary").first()
    assert (told.stage, told.rows, told["last"], told.states.asDict()) == ("stage", 4, 4, {"done": 2, "new": 1, "unknown": 1})
    assert rows(sinks.read_summary(spark, f"{out}/summary"), "state", "n") == [("all", 4), ("done", 2), ("new", 1), ("unknown", 1)]
    sinks.run_summary("none", states.where("false"), "state", f"{out}/empty")
    assert rows(sinks.read_summary(spark, f"{out}/empty"), "state", "n") == [("all", 0)]


def test_edit_rows_of_all_versions(spark, tmp_path):
    root = str(tmp_path / "catalog")
    node = spark.createDataFrame([("a",)], "name string")
    sinks.checkpoint_sink(spark, root, {"node": node})
    assert sinks.edit_rows(spark, root, ["operation"]).count() == 0
    for n, operations in enumerate((["x", "y"], [], ["z"]), 1):
        sinks.checkpoint_sink(spark, root, {"node": node}, spark.createDataFrame([(o,) for o in operations], "operation string"))
    got = rows(sinks.edit_rows(spark, root, ["operation"]), "version", "from_checkpoint", "operation")
    assert got == [(1, "query_induced_round0", "x"), (1, "query_induced_round0", "y"), (3, "query_induced_round2", "z")]


def test_front_matter(spark):
    good = "---\nname: a-b\ndescription: \"say \\\"hi\\\"\"\n---\n# T\nbody"
    quoted = "---\nname: x\ndescription: 'it''s'\n---\n"
    bad = ["name: x", "---\nname: x\n---\nb", "---\nname: x\ndescription: y\nextra: z\n---\nb", "---\nname: x\nname: y\ndescription: z\n---\n", "---\nname: x\ndescription:\n---\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([good, quoted, *bad])], "i int, t string")
    got = [r.f for r in df.select("i", tx.front_matter(F.col("t")).alias("f")).orderBy("i").collect()]
    assert (got[0].name, got[0].description, got[0].body, got[0].ok) == ("a-b", 'say "hi"', "# T\nbody", True)
    assert got[1].description == "it's" and got[1].ok
    assert not any(f.ok for f in got[2:])


def attempts_log(spark):
    from datetime import datetime, timedelta

    def row(i):
        status = "failed" if i % 5 in (0, 1) or 40 <= i < 70 else "accepted"
        return (i, datetime(2024, 1, 1) + timedelta(seconds=i // 2), f"r{i % 2}", f"p{i % 3 % 2}", status, i % 10 == 5, float(i * 7 % 23) * (1 + i % 2 * 3))

    schema = "event_id long, ts timestamp, route string, phase string, status string, invalid boolean, latency double"
    return spark.createDataFrame([row(i) for i in range(200)], schema)


def streamed(spark, tmp_path, df, make):
    """Three arrivals in separate runs, a part of each late, then rows that only move the watermark on."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    end = df.limit(1).selectExpr("event_id", "timestamp '2030-01-01' AS ts", "null AS route", "null AS phase", "null AS status", "null AS invalid", "null AS latency")
    late = F.when(F.col("event_id") % 7 == 0, 30).otherwise(0)
    for k, (low, high) in enumerate(((0, 80), (80, 130), (130, 300))):
        at = F.col("event_id") + late
        part = df.where((at >= low) & (at < high))
        (part.unionByName(end) if k == 2 else part).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src).withWatermark("ts", "60 seconds")
        health.start(make(stream), out, str(tmp_path / "checkpoint")).awaitTermination()
    return spark.read.parquet(out)


def test_health_stream_equals_batch(spark, tmp_path):
    df = attempts_log(spark)
    got = streamed(spark, tmp_path, df, health.route_health_stream)
    assert got.count() == df.count()
    flags = got.where("seen is not null")
    assert rows(flags, "event_id", "rate", "seen", "flagged") == rows(reqlog.error_window(df), "event_id", "rate", "seen", "flagged")
    assert flags.where("flagged").count() > 0 and got.where("failures_before = 10").count() > 0
    wins = got.where("failures_before is not null")
    assert rows(wins, "event_id", "failures_before") == rows(reqlog.failure_runs(df), "event_id", "failures_before")


def test_latency_stream_equals_batch(spark, tmp_path):
    df = attempts_log(spark)
    got = {(r.route, r.phase): r for r in health.latest(streamed(spark, tmp_path, df, health.latency_stream)).collect()}
    want = {(r.route, r.phase): r for r in reqlog.latency_ewma(df).collect()}
    assert got.keys() == want.keys() and any(r.slow for r in want.values())
    for key, r in want.items():
        assert (got[key].samples, got[key].slow) == (r.samples, r.slow)
        assert got[key].ewma == pytest.approx(r.ewma) and got[key].best == pytest.approx(r.best)


def test_publish_keeps_the_latest_epoch(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "k int, ord int, v string"
    for data in ([(1, 1, "a"), (2, 2, "b")], [(2, 2, "c")]):
        spark.createDataFrame(data, schema).write.mode("append").parquet(src)
        publish_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck"), every=None).awaitTermination()
    assert rows(published(spark, out, "k", "ord"), "k", "v") == [(1, "a"), (2, "c")]


def test_infer_retries_and_quarantine(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "late"), (3, "never"), (4, "boom")], "k int, p string")

    def client():
        def ask(prompt):
            if prompt.startswith("boom"):
                raise RuntimeError("down")
            return "good" if prompt.startswith("ok") or ("late" in prompt and "invalid" in prompt) else "bad"

        return ask

    attempts = infer.batch_infer(df, "k", "p", client, lambda r: None if r == "good" else "not good", 2).cache()
    accepted, failed = infer.split_attempts(attempts, "k")
    assert rows(accepted, "k", "attempt") == [(1, 1), (2, 2)]
    assert rows(failed, "k", "error") == [(3, "not good"), (4, "RuntimeError: down")]
