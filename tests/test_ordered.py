import random

import pytest
from pyspark.sql import Window, functions as F

from conftest import rows
from routeloom.operators import ordered, ranking, reqlog


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(5)
    data = [("hot" if r.random() < 0.7 else f"k{r.randrange(5)}", i, r.randrange(100)) for i in range(500)]
    r.shuffle(data)
    return spark.createDataFrame(data, "k string, t int, x int")


@pytest.mark.parametrize("slices", [1, 3, 20])
@pytest.mark.parametrize("keys", [["k"], []])
def test_slices_equal_a_plain_window(spark, events, keys, slices):
    specs = {
        "n": ("count", F.lit(1), True),
        "before": ("sum", F.col("x"), False),
        "upto": ("sum", F.col("x"), True),
        "top": ("max", F.col("x"), False),
        "low": ("min", F.col("x"), True),
    }
    cols = ["k", "t", "x", *specs]
    whole = Window.partitionBy(*keys).orderBy("t")
    upto, before = (whole.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))
    plain = events.withColumns({
        "n": F.count(F.lit(1)).over(upto), "before": F.coalesce(F.sum("x").over(before), F.lit(0)), "upto": F.sum("x").over(upto),
        "top": F.max("x").over(before), "low": F.min("x").over(upto),
    })
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        sliced = ordered.running(events, keys, ["t"], specs).select(*cols).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    key = lambda r: r["t"]
    assert sorted(plain.select(*cols).collect(), key=key) == sorted(sliced, key=key)


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(30)] + [("a", i) for i in range(5)], "k string, t int")
    got = ordered.positions(df, ["k"], ["t"])
    assert got.count() == 35
    assert got.where("k IS NULL").agg(F.max("pos")).first()[0] == 30
    assert ordered.positions(df.where("false"), ["k"], ["t"]).count() == 0


def test_long_top_k_equals_the_window(events, monkeypatch):
    want = rows(ordered.top_k(events, ["k"], ["x", "t"], 5), "k", "t", "rank")
    monkeypatch.setattr(ordered, "EARLY_LIMIT", 2)
    assert rows(ordered.top_k(events, ["k"], ["x", "t"], 5), "k", "t", "rank") == want


def test_trailing_blocks_equal_one_window(events):
    placed = ordered.positions(events, ["k"], ["t"])
    aggs = {"s": F.sum("x"), "c": F.count(F.lit(1))}
    small = ordered.trailing(placed, ["k"], "pos", 3, 2, aggs, block=7)
    large = ordered.trailing(placed, ["k"], "pos", 3, 2, aggs)
    assert rows(small, "k", "pos", "s", "c") == rows(large, "k", "pos", "s", "c")
    assert small.count() == events.count()


def test_top_k_limits_before_the_shuffle(events):
    plan = ordered.top_k(events, ["k"], [F.desc("x"), "t"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_char_budget_cuts_the_crossing_row(spark):
    df = spark.createDataFrame([("a", 1, "xxxx"), ("a", 2, "yyyy"), ("a", 3, "zzzz"), ("b", 1, "q")], "k string, o int, t string")
    got = ranking.char_budget(df, ["k"], ["o"], "t", 6)
    assert rows(got, "k", "o", "t", "truncated") == [("a", 1, "xxxx", False), ("a", 2, "yy", True), ("b", 1, "q", False)]


def test_round_robin_takes_categories_in_turn(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("a", 4), ("c", 5)], "c string, o int")
    got = ranking.round_robin_sample(df, "c", ["o"], 4).select("c", "o").collect()
    assert [tuple(r) for r in got] == [("a", 2), ("b", 1), ("c", 5), ("a", 3)]


def test_slice_rows(events):
    got = [r.t for r in ranking.slice_rows(events, ["t"], 10, 5).orderBy("t").collect()]
    assert got == [10, 11, 12, 13, 14]
    assert ranking.slice_rows(events, ["t"], 490).count() == 10


def test_error_window_needs_twenty_samples(spark):
    data = [(i, i, "r", "failed" if i < 10 else "accepted", False) for i in range(25)]
    df = spark.createDataFrame(data, "event_id int, ts int, route string, status string, invalid boolean")
    got = {r.event_id: r for r in reqlog.error_window(df).collect()}
    assert got[0].rate == 1.0 and not got[0].flagged
    assert got[19].flagged and got[19].rate == 0.5
    assert not got[24].flagged and got[24].rate == 0.25


def test_failure_runs_are_capped(spark):
    data = [(i, i, "r", "accepted" if i in (0, 13, 15) else "failed") for i in range(16)]
    df = spark.createDataFrame(data, "event_id int, ts int, route string, status string")
    assert rows(reqlog.failure_runs(df), "event_id", "failures_before") == [(0, 0), (13, 10), (15, 1)]


def test_ewma_equals_the_fold(spark):
    r = random.Random(1)
    xs = [r.uniform(1, 30) for _ in range(40)]
    df = spark.createDataFrame([(i, i, "r", "p", "accepted", x) for i, x in enumerate(xs)], "event_id int, ts int, route string, phase string, status string, latency double")
    e = xs[0]
    for x in xs[1:]:
        e = 0.8 * e + 0.2 * x
    assert reqlog.latency_ewma(df).first().ewma == pytest.approx(e)


def test_evidence_excerpt_rules(spark):
    body = "\n".join(["a", "b", "<canvas>", "d", "e", "f", "class=x", "h"])
    data = [("s", "main.js", 0, ".js", body), ("s", "z.js", 1, ".js", "plain"), ("s", "index.html", 0, ".html", "nothing here")]
    df = spark.createDataFrame(data, "site string, path string, pref int, suffix string, text string")
    got = ranking.evidence_excerpt(df, "site", "path", "text", F.col("suffix"), F.col("path") == "index.html")
    blocks = {r.path: r.block for r in got.collect()}
    assert blocks["main.js"] == "FILE main.js\n1: a\n2: b\n3: <canvas>\n4: d\n5: e\n6: f\n7: class=x\n8: h"
    assert blocks["index.html"] == "FILE index.html\nnothing here"
    assert "z.js" not in blocks
    # The stop counts repeated context lines: the second hit is not reached.
    short = ranking.evidence_excerpt(df, "site", "path", "text", F.col("suffix"), F.lit(False), hit_chars=10)
    assert short.where("path = 'main.js'").first().block.endswith("5: e")
