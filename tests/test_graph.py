import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from routeloom.operators import graph


def table(spark, edges):
    return spark.createDataFrame(edges, "parent string, child string")


def random_dag(seed, n=14):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    return names, sorted({(names[i], names[j]) for i in range(n) for j in range(i + 1, n) if r.random() < 0.2})


def nodes_of(spark, names, edges):
    below = {c for _, c in edges}
    return spark.createDataFrame([(x, f"Fits {x}", x not in below) for x in names], "name string, description string, is_root boolean")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_depth_and_closure_against_dfs(spark, seed):
    names, edges = random_dag(seed)
    kids = {x: [c for p, c in edges if p == x] for x in names}
    roots = set(names) - {c for _, c in edges}

    def depth(x):
        above = [p for p, c in edges if c == x]
        return 0 if x in roots else 1 + max(depth(p) for p in above)

    def below(x):
        return {x}.union(*[below(c) for c in kids[x]])

    nodes, edge = nodes_of(spark, names, edges), table(spark, edges)
    assert rows(graph.longest_depth(nodes, edge), "name", "depth") == sorted((x, depth(x)) for x in names)
    got = rows(graph.descendants(nodes, edge), "node", "below")
    assert got == sorted((x, y) for x in names for y in below(x))
    assert rows(graph.infer_roots(nodes, edge), "name") == sorted((x,) for x in roots)
    assert graph.cyclic_nodes(edge).isEmpty()


def test_choose_all_routes_everything_reachable(spark):
    names, edges = random_dag(4)
    nodes, edge = nodes_of(spark, names, edges), table(spark, edges)
    queries = spark.createDataFrame([(1, " ".join(names))], "query_id int, query string")
    got = {r.name for r in graph.route_dag(queries, nodes, edge).collect()}
    assert got == set(names)


def test_revisit_at_two_depths(spark):
    edges = [("r", "a"), ("a", "b"), ("r", "b")]
    nodes = nodes_of(spark, ["r", "a", "b"], edges)
    queries = spark.createDataFrame([(1, "r a b")], "query_id int, query string")
    got = rows(graph.route_dag(queries, nodes, table(spark, edges)), "name", "level")
    assert got == [("a", 2), ("b", 2), ("b", 3), ("r", 1)]


def test_planted_cycle(spark):
    edge = table(spark, [("r", "a"), ("a", "b"), ("b", "a"), ("b", "z")])
    assert rows(graph.cyclic_nodes(edge), "name") == [("a",), ("b",)]
    nodes = spark.createDataFrame([("r", "", True), ("a", "", False), ("b", "", False), ("z", "", False)], "name string, description string, is_root boolean")
    with pytest.raises(graph.CycleError):
        graph.longest_depth(nodes, edge)


def test_merge_chain_and_cycle(spark):
    chain = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(9)]
    df = spark.createDataFrame(chain, "skill string, merged_into string")
    assert {r.canonical for r in graph.resolve_merges(df).collect()} == {"s0"}
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "skill string, merged_into string")
    with pytest.raises(graph.CycleError):
        graph.resolve_merges(loop)


def test_lexical_score_rounds_down(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "z"])], "q array<string>, d array<string>")
    got = df.select(graph.lexical_score(F.col("q"), F.col("d")).alias("x"), graph.lexical_score(F.col("q"), F.col("d"), "text").alias("y")).first()
    assert (got.x, got.y) == (33, 50)


@pytest.mark.parametrize("threshold", [1, 40, 67, 100])
def test_root_choice_without_cross_join_is_exact(spark, threshold):
    r = random.Random(threshold)
    words = [f"w{i}" for i in range(8)]
    cards = [(f"c{i}", sorted(r.sample(words, r.randrange(1, 6)))) for i in range(20)]
    asked = [(i, sorted(r.sample(words, r.randrange(1, 8)))) for i in range(20)]
    got = rows(
        graph.choose_by_text(spark.createDataFrame(asked, "query_id int, words array<string>"), spark.createDataFrame(cards, "name string, words array<string>"), threshold),
        "query_id", "name", "score",
    )
    want = []
    for q, qw in asked:
        for n, cw in cards:
            s = 100 * len(set(qw) & set(cw)) // len(cw)
            if s >= threshold:
                want.append((q, n, s))
    assert got == sorted(want)


def test_integrity(spark):
    names = spark.createDataFrame([("r",)], "name string")
    roots = spark.createDataFrame([("r",), ("x",)], "name string")
    members = spark.createDataFrame([("r", "s", 0), ("r", "old", 1), ("r", "lost", 2)], "node string, skill string, pos int")
    skills = spark.createDataFrame([("s", None), ("old", "s")], "skill string, merged_into string")
    live = graph.resolve_merges(skills)
    got = graph.integrity_defects(names, roots, table(spark, [("r", "y")]), members, live, skills)
    assert rows(got, "kind", "name") == [("unknown_child", "y"), ("unknown_root", "x"), ("unknown_skill", "lost")]


def test_review_equals_union_then_score(spark):
    chosen = spark.createDataFrame([(1, 1, "r", 100), (1, 2, "k", 90), (2, 1, "r", 95)], "query_id int, level int, name string, score int")
    members = spark.createDataFrame([("r", "a", 2), ("r", "old", 1), ("k", "b", 1), ("k", "a", 0)], "node string, skill string, pos int")
    skills = spark.createDataFrame([("a", None), ("b", None), ("old", "a")], "skill string, merged_into string")
    live = graph.resolve_merges(skills)
    queries = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"])], "query_id int, q array<string>")
    docs = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"])], "skill string, d array<string>")
    got = rows(graph.review_candidates(chosen, members, live, queries, docs, 60), "query_id", "skill", "score", "applicable")
    assert got == [(1, "a", 50, False), (1, "b", 100, True), (2, "a", 100, True)]
    union = graph.candidate_union(chosen, members, live)
    both = graph.review_candidates(chosen, members, live, queries, docs, 60)
    assert rows(union, "query_id", "skill", "seen") == rows(both, "query_id", "skill", "seen")


def test_routing_follows_a_deep_chain(spark):
    names = [f"n{i:02d}" for i in range(70)]
    edges = list(zip(names, names[1:]))
    nodes = spark.createDataFrame([(x, "Fits word", x == "n00") for x in names], "name string, description string, is_root boolean")
    queries = spark.createDataFrame([(1, "word")], "query_id int, query string")
    got = graph.route_dag(queries, nodes, table(spark, edges))
    assert [n for _, n in rows(got, "level", "name")] == names
