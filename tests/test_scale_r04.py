"""Whole results where a cap or a cut list stood before."""

from types import SimpleNamespace

from routeloom.operators import evidence
from routeloom.plans import q_patches

RELATION = "query_id int, source string, a string, b string, relation string, reason string, split_parent string, distinction string"


def test_merge_gate_judges_every_repeated_pair(spark):
    names = [f"s{i:03d}" for i in range(171)]
    pairs = list(zip(names, names[1:]))
    rel = spark.createDataFrame([(q, s, a, b, "same", "r", "", "") for a, b in pairs for q, s in ((1, a), (2, b))], RELATION)
    view = SimpleNamespace(
        relation=rel,
        member=spark.createDataFrame([("p", n, i) for i, n in enumerate(names)], "node string, skill string, pos int"),
        node=spark.createDataFrame([("top", True), ("p", False)], "name string, is_root boolean"),
        edge=spark.createDataFrame([("top", "p")], "parent string, child string"),
    )
    got = {(r.a, r.b): r.outcome for r in q_patches.merge_gate(view).collect()}
    assert got == dict.fromkeys(pairs, "ok")


def test_relation_details_lists_all_requests_and_sources(spark):
    data = [(q, s, "x", "y", "same", f"r{q}", "", "", "p") for q, s in ((12, "y"), (3, "x"), (3, "x"), (7, "y"), (5, "x"))]
    placed = spark.createDataFrame(data, f"{RELATION}, parent string")
    got = evidence.relation_details(placed, evidence.relation_support(placed)).first()
    assert (list(got.ids), list(got.sources)) == ([3, 5, 7, 12], ["x", "y"])
    assert (list(got.first_ids), got.n_sources, got.support) == ([3, 5], 2, 4)
