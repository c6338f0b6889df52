from pyspark.sql import functions as F

from conftest import rows
from routeloom.operators import evidence, patches

ALT = evidence.ALTERNATIVE


def relations(spark, data):
    return spark.createDataFrame(data, "query_id int, source string, a string, b string, relation string, reason string, split_parent string, distinction string")


def graph_tables(spark):
    nodes = spark.createDataFrame([("top",), ("deep",), ("deep2",), ("other",), ("far",)], "name string")
    depth = spark.createDataFrame([("top", 0), ("deep", 2), ("deep2", 2), ("other", 0)], "name string, depth int")
    member = spark.createDataFrame(
        [("top", "x"), ("top", "y"), ("deep", "x"), ("deep", "y"), ("deep2", "x"), ("deep2", "y"), ("other", "z"), ("far", "w")],
        "node string, skill string",
    )
    return nodes, depth, member


def test_deepest_common_parents_tie_and_fallbacks(spark):
    nodes, depth, member = graph_tables(spark)
    rel = relations(
        spark,
        [
            (1, "x", "x", "y", ALT, "", "other", "d"),
            (1, "x", "w", "z", ALT, "", "top", "d"),
            (1, "x", "w", "z", ALT, "", "nowhere", "d"),
            (2, "x", "w", "z", "same", "", "", ""),
        ],
    )
    got = rows(evidence.evidence_parents(rel, member, depth, nodes), "a", "b", "relation", "split_parent", "parent")
    assert got == [
        ("w", "z", ALT, "top", "top"), ("w", "z", "same", "", "far"), ("w", "z", "same", "", "other"),
        ("x", "y", ALT, "other", "deep"), ("x", "y", ALT, "other", "deep2"),
    ]


def test_support_counts_distinct_requests_and_misses_count_rows(spark):
    nodes, depth, member = graph_tables(spark)
    rel = relations(spark, [(q, "x", "x", "y", "same", f"r{q}", "", "") for q in (1, 1, 2, 3)])
    placed = evidence.relation_rows(rel, evidence.evidence_parents(rel, member, depth, nodes))
    support = evidence.relation_support(placed)
    assert {r.support for r in support.collect()} == {3}
    detail = evidence.relation_details(placed, support).where("parent = 'deep'").first()
    assert list(detail.first_ids) == [1, 2] and len(detail.reasons) == 3 and detail.n_sources == 1
    misses = spark.createDataFrame([(7, "x", "rewrite_skill", "x"), (7, "x", "rewrite_skill", "x"), (8, "z", "add_edge", "top")], "query_id int, source string, operation string, target string")
    kept = evidence.repeated_miss(evidence.miss_rows(misses, member, nodes))
    assert rows(kept.groupBy("parent").count(), "parent", "count") == [("deep", 2), ("deep2", 2), ("top", 2)]


def test_split_parents_tie_by_name_descending(spark):
    df = spark.createDataFrame([("a", 5, True, 12), ("b", 5, True, 12), ("c", 9, False, 0)], "parent string, score int, eligible boolean, minimum_move int")
    got = evidence.select_split_parents(df, 1)
    assert rows(got, "parent", "split_required", "minimum_move") == [("a", False, 0), ("b", True, 12), ("c", False, 0)]


def test_minimum_move_is_the_ceiling(spark):
    data = [("p", f"a{i:02d}", f"b{i:02d}", ALT, 2) for i in range(20)]
    top = spark.createDataFrame(data, "parent string, a string, b string, relation string, support int")
    skills = spark.createDataFrame([(x,) for i in range(20) for x in (f"a{i:02d}", f"b{i:02d}")], "skill string")
    got = evidence.split_eligibility(top, skills).first()
    assert (got.n_skills, got.minimum_move, got.eligible, got.score) == (40, 24, True, 40)


def test_partition_seed_budget(spark):
    data = [("p", f"s{i:02d}", f"s{i + 1:02d}", ALT if i % 2 else "same", 100 - i) for i in range(60)]
    top = spark.createDataFrame(data, "parent string, a string, b string, relation string, support long")
    got = patches.partition_seed(top, cap=16).orderBy("seq").collect()
    names = {n for r in got for n in (r.a, r.b)}
    assert 4 <= len(names) <= 16
    first = [r for r in got if r.relation == ALT][:4]
    assert [r.seq for r in first] == [1, 2, 3, 4]
    assert any(r.relation == "same" for r in got)
    assert all(r.sufficient for r in got)


def test_partition_seed_marks_too_little_evidence(spark):
    data = [("few", "a", "b", ALT, 5), ("alike", "a", "b", "same", 4), ("alike", "c", "d", "same", 3)]
    top = spark.createDataFrame(data, "parent string, a string, b string, relation string, support int")
    got = rows(patches.partition_seed(top), "parent", "seq", "sufficient")
    assert got == [("alike", 1, False), ("alike", 2, False), ("few", 1, False)]


def test_partition_seed_order_of_choice(spark):
    data = [("p", "a", "b", ALT, 9), ("p", "c", "d", ALT, 8), ("p", "e", "f", ALT, 7), ("p", "x", "y", "same", 9), ("p", "a", "z", "same", 1)]
    top = spark.createDataFrame(data, "parent string, a string, b string, relation string, support int")
    got = patches.partition_seed(top, cap=7).orderBy("seq").collect()
    assert [(r.a, r.b) for r in got] == [("a", "b"), ("c", "d"), ("a", "z"), ("e", "f")]


def test_verdict_gives_the_orientation(spark):
    proposed = spark.createDataFrame([("x", "y", 1, 1), ("y", "x", 2, 2), ("x", "y", 1, 3)], "keep string, remove string, query_id int, ord int")
    cand = evidence.merge_candidates(proposed)
    assert rows(cand, "keep", "remove", "evidence") == [("x", "y", 2)]
    verdict = spark.createDataFrame([("y", "x", True, "y")], "a string, b string, equivalent boolean, keep string")
    assert rows(evidence.pair_verdict(cand, verdict), "keep", "remove") == [("y", "x")]


def test_digest_shows_alternatives_first(spark):
    top = spark.createDataFrame([("p", "a", "b", "same", 9, 1), ("p", "c", "d", ALT, 2, 2)], "parent string, a string, b string, relation string, support int, rank int")
    got = evidence.relation_digest(top).orderBy("shown").collect()
    assert [r.a for r in got] == ["c", "a"]
    assert [r.a for r in evidence.relation_digest(top, 1).collect()] == ["c"]


def test_typed_evidence_keeps_same_and_misses(spark):
    top = spark.createDataFrame([("p", "a", "b", "same", 2), ("p", "c", "d", ALT, 2)], "parent string, a string, b string, relation string, support int")
    misses = spark.createDataFrame([("q", "m")], "parent string, source string")
    same, _, names = evidence.typed_evidence(top, misses)
    assert same.count() == 1
    assert rows(names, "parent", "skill") == [("p", "a"), ("p", "b"), ("q", "m")]
    assert F.col is not None
