"""Vector store range reads, two-phase source scans, leaks by automaton, routing results."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from routeloom.operators import graph, resume
from routeloom.sources import files, vector_store


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_store_reads_a_group_by_its_range(spark, tmp_path):
    data = [(f"g{k % 7}", k, [float(k), 1.0]) for k in range(200)]
    df = spark.createDataFrame(data, "label string, id long, v array<double>")
    vector_store.save(df, str(tmp_path / "s"), "label", "id", "v", folder_rows=16)
    store = vector_store.open_store(spark, str(tmp_path / "s"))
    assert store.facts == {"dims": 2, "n": 200, "folder_rows": 16, "unit": False}
    assert rows(store.offsets, "group", "start", "stop")[:2] == [("g0", 0, 29), ("g1", 29, 58)]
    one = store.group("g3")
    assert rows(one, "key") == [(k,) for k in range(3, 200, 7)]
    plan = plan_of(one)
    assert "PartitionFilters: [isnotnull(folder" in plan and "PushedFilters: [IsNotNull(row), GreaterThanOrEqual(row," in plan
    # the folders of the group only: 29 rows lie in at most three folders of 16
    assert 1 < one.select(F.input_file_name()).distinct().count() <= 3
    wanted = spark.createDataFrame([("g1",), ("g5",), ("none",)], "group string")
    assert rows(store.groups(wanted), "group", "key") == sorted((f"g{k % 7}", k) for k in range(200) if k % 7 in (1, 5))
    assert store.group("none").count() == 0 and store.span(0, 58).count() == 58


def test_store_contract(spark, tmp_path):
    bad = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [1.0, 2.0])], "g string, k long, v array<double>")
    with pytest.raises(ValueError, match="differ in length"):
        vector_store.save(bad, str(tmp_path / "bad"), "g", "k", "v")
    with pytest.raises(ValueError, match="null"):
        vector_store.save(spark.createDataFrame([("a", 1, None)], "g string, k long, v array<double>"), str(tmp_path / "null"), "g", "k", "v")
    vector_store.save(bad.where("false"), str(tmp_path / "none"), "g", "k", "v")
    assert vector_store.open_store(spark, str(tmp_path / "none")).group("a").count() == 0
    vector_store.save(bad.where("k = 1"), str(tmp_path / "one"), "g", "k", "v")
    spark.createDataFrame([("b", 0, 5)], "group string, start long, stop long").write.mode("append").parquet(str(tmp_path / "one" / "offsets"))
    with pytest.raises(ValueError, match="cover"):
        vector_store.open_store(spark, str(tmp_path / "one"))


def test_only_chosen_files_are_opened(spark, tmp_path):
    """Any file longer than the limit fails when its bytes are read; those of pruned folders and names are not."""
    site = tmp_path / "0001-site [a]{b}"
    for name, body in {
        "index.html": "<p>é</p>", "src/app.js": "x()", "node_modules/big.js": "y" * 5000, "big.png": "z" * 5000, "metadata.json": "m" * 5000, "empty.css": "",
    }.items():
        path = site / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        got = files.source_tree_scan(spark, str(tmp_path))
        assert rows(got, "path", "pref", "text") == [("index.html", 0, "<p>é</p>"), ("src/app.js", 0, "x()")]
        (site / "src" / "long.js").write_text("w" * 5000)
        with pytest.raises(Exception, match="long.js"):
            files.source_tree_scan(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert files.source_tree_scan(spark, str(tmp_path / "0001-site [a]{b}" / "node_modules")).count() == 0


def test_leaks_against_plain_search(spark, monkeypatch):
    monkeypatch.setattr(resume, "COPY_ROWS", 7)
    texts = ["Abcde", "xab", "bcd cd", "", None, "zz ABC", "d"]
    docs = [(k, "one" if k % 3 else "two", texts[k % 7]) for k in range(60)] + [(90, None, "abc"), (91, "three", "abc")]
    tokens = [("one", t) for t in ("ab", "abc", "bcd", "CD", "", "ab")] + [("two", "d"), (None, "abc")]
    got = resume.identity_leaks(
        spark.createDataFrame(docs, "id int, site string, t string"), spark.createDataFrame(tokens, "site string, token string"), "site", "id", "t"
    )
    want = []
    for k, site, t in docs:
        n = len({w.lower() for s, w in tokens if s == site and site and w and w.lower() in (t or "").lower()})
        want += [(k, n)] if n else []
    assert rows(got, "id", "leaks") == want


def test_routing_result_lists(spark):
    nodes = spark.createDataFrame(
        [("r", "Fits red", True), ("s", "Fits blue", True), ("t", "Fits red big", False), ("u", "Fits red blue", False)], "name string, description string, is_root boolean"
    )
    edges = spark.createDataFrame([("r", "t"), ("r", "u"), ("s", "u")], "parent string, child string")
    members = spark.createDataFrame([("t", "a", 1), ("u", "b", 2), ("u", "a", 3), ("s", "c", 4)], "node string, skill string, pos int")
    live = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "name string, canonical string")
    queries = spark.createDataFrame([(1, "red blue thing"), (2, "green")], "query_id int, query string")
    trace = graph.route_trace(queries, nodes, edges)
    assert rows(trace.na.fill("-"), "query_id", "level", "parent", "name") == [(1, 1, "-", "r"), (1, 1, "-", "s"), (1, 2, "r", "u"), (1, 2, "s", "u")]
    got = graph.routing_result(trace, nodes, edges, members, live)
    assert rows(got["selected"], "name", "level", "kind", "is_leaf") == [("r", 1, "root", False), ("s", 1, "root", True), ("u", 2, "descendant", True)]
    assert rows(got["levels"], "level", "asked", "chosen") == [(1, 2, 2), (2, 2, 1)]
    assert rows(got["candidates"], "skill") == [("a",), ("c",)]
    assert rows(got["below"], "below") == [("r",), ("s",), ("t",), ("u",)]
