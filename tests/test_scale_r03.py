"""Steps that once grew faster than their input: the whole result by a cheaper way."""

import random

from pyspark.sql import functions as F

from conftest import rows
from routeloom.functions import text as tx
from routeloom.operators import evidence, graph, ranking, similarity
from routeloom.plans.views import Views


def test_similar_sets_equal_brute_force(spark):
    r = random.Random(5)
    base = [r.sample(range(40), 12) for _ in range(6)]
    sets = []
    for k in range(90):
        words = set(base[k % 6])
        for _ in range(r.randrange(4)):
            words ^= {r.randrange(40)}
        sets.append(("g" if k % 2 else "h", f"s{k:02d}", sorted(f"w{x}" for x in words), 1, k))
    df = spark.createDataFrame(sets, "g string, set_id string, tokens array<string>, copies long, first_key long")
    for threshold in (0.5, 0.8, 1.0):
        want = [
            (a[0], a[1], b[1]) for a in sets for b in sets
            if a[0] == b[0] and a[1] < b[1] and len({*a[2]} & {*b[2]}) >= threshold * len({*a[2]} | {*b[2]}) - 1e-12
        ]
        assert rows(similarity.similar_sets(df, "g", threshold), "g", "x", "y") == sorted(want)


def test_first_object_cleans_a_reply_once(spark):
    df = spark.createDataFrame([('x {"a":[{"b":"}"},1]} y',)], "x string").select(tx.first_json_object(F.col("x")).alias("v"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 3
    assert df.first().v == '{"a":[{"b":"}"},1]}'


def test_first_candidates_are_those_of_the_whole_review(spark):
    r = random.Random(9)
    chosen = [(q, r.randrange(1, 3), f"n{k}", 100 - k) for q in range(6) for k in range(3)]
    members = [(f"n{r.randrange(3)}", f"s{k % 50}", k) for k in range(140)]
    words = [f"w{k}" for k in range(6)]
    asked = [(q, r.sample(words, 4)) for q in range(6)] + [(0, r.sample(words, 3))]
    docs = [(f"s{k}", r.sample(words, 3)) for k in range(50)] + [("s1", words)]
    args = (
        spark.createDataFrame(chosen, "query_id int, level int, name string, score int"),
        spark.createDataFrame(members, "node string, skill string, pos int"),
        spark.createDataFrame([(f"s{k}", f"s{k}" if k else "s1") for k in range(50)], "name string, canonical string"),
        spark.createDataFrame(asked, "query_id int, q array<string>"),
        spark.createDataFrame(docs, "skill string, d array<string>"),
    )
    whole, first = graph.review_candidates(*args, 50), graph.review_candidates(*args, 50, k=4)
    top = lambda x: rows(ranking.rank_topk(x, "query_id", ["seen"], 4), "query_id", "rank", "skill", "score", "seen")
    assert top(first) == top(whole)
    assert first.count() < whole.count()
    blank = graph.review_candidates(*args[:4], spark.createDataFrame([("s2", None)], "skill string, d array<string>"), 50)
    assert {(x.skill, x.score, x.applicable) for x in blank.collect()} == {("s2", None, None)}  # a skill without words stays a candidate
    held = args[1].join(args[2], F.col("skill") == F.col("name")).select("node", F.col("canonical").alias("skill")).distinct()
    assert rows(graph.candidate_counts(args[0], held), "query_id", "candidates") == rows(whole.groupBy("query_id").count(), "query_id", "count")


def test_requests_that_route_alike_are_one_class(spark):
    asked = spark.createDataFrame([(3, "a b"), (1, "b, A"), (2, "a c"), (5, None), (1, "b A")], "query_id int, query string")
    assert rows(graph.request_classes(asked), "query_id", "like") == [(1, 1), (2, 2), (3, 1), (5, 5)]
    trace = [(1, 1, None, "r", 90), (2, 1, None, "r", 90), (1, 2, "r", "a", 95), (2, 2, "r", "a", 95), (4, 1, None, "r", 90)]
    df = spark.createDataFrame(trace, "query_id int, level int, parent string, name string, score int")
    assert rows(graph.trace_classes(df), "query_id", "like") == [(1, 1), (2, 1), (4, 4)]


def test_relations_need_no_numbered_batch(spark, tmp_path):
    part = [(k, f"p {k}", f"Brand#{k % 3}", "LARGE" if k % 2 else "SMALL", 10 * k, 1.0) for k in range(5)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(7, k, 9 - k, 0.01 * k, "R", "O") for k in range(5)] + [(8, 1, 1, 0.0, "A", "F"), (8, 99, 0, 0.0, "N", "F"), (8, 3, 2, 0.0, "A", "F")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    v = Views(spark, str(tmp_path))
    got = rows(v.relation, "query_id", "source", "a", "b", "relation", "split_parent")
    assert [g[:4] for g in got] == [(7, "part_4", f"part_{a}", f"part_{b}") for a in range(5) for b in range(a + 1, 5)] + [(8, "part_99", "part_1", "part_3")]
    assert got[0][4:] == ("alternative_same_position", "type_small") and got[-1][4:] == ("same", "")
    assert rows(v.diagnosis, "query_id", "source") == [(7, "part_4")]
    assert "batch" not in v.__dict__


def test_repeated_relations_are_written_small_first(spark):
    data = [("a", "b", "same", 1), ("a", "b", "same", 1), ("a", "c", "same", 1), ("a", "c", "same", 2), ("a", "c", "same", 3)]
    df = spark.createDataFrame(data, "a string, b string, relation string, query_id int")
    assert rows(evidence.repeated_relations(df), "b", "query_id") == [("c", 1), ("c", 2), ("c", 3)]
    assert rows(evidence.repeated_relations(df, 3), "b", "query_id") == [("c", 1), ("c", 2), ("c", 3)]
