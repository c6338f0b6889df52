"""Routing graph queries."""

from pyspark.sql import functions as F

from routeloom.operators import graph, ranking
from routeloom.plans.registry import query
from routeloom.session import cut_lineage

_WORDS = (
    "list_filter(list_distinct(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ')), "
    "lambda x: x NOT IN ('', 'fits'))"
)
_QWORDS = (
    "list_filter(list_distinct(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ')), "
    "lambda x: x <> '')"
)
CHOSEN_SQL = f"""card AS MATERIALIZED (SELECT name, is_root, {_WORDS.format('description')} AS words FROM node),
ask AS MATERIALIZED (SELECT query_id, source, query, {_QWORDS.format('query')} AS q FROM route_query),
chosen AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE walk(query_id, level, name, score) AS (
  SELECT query_id, 1, name, CAST(floor(100 * len(list_intersect(q, words)) / len(words)) AS INTEGER) AS score
  FROM ask, card WHERE is_root AND floor(100 * len(list_intersect(q, words)) / len(words)) >= 90
  UNION
  SELECT w.query_id, w.level + 1, c.name, CAST(floor(100 * len(list_intersect(q, words)) / len(words)) AS INTEGER)
  FROM walk w JOIN edge e ON e.parent = w.name JOIN card c ON c.name = e.child JOIN ask a ON a.query_id = w.query_id
  WHERE floor(100 * len(list_intersect(q, words)) / len(words)) >= 90)
  SELECT * FROM walk)),
cand AS MATERIALIZED (SELECT query_id, k.canonical AS skill, min((level, -score, c.name, m.pos)) AS seen
  FROM chosen c JOIN member m ON m.node = c.name JOIN canonical k ON k.name = m.skill GROUP BY ALL)"""
ROUTE_VIEWS = ("node", "edge", "member", "canonical", "route_query")


@query("resolve_merges", "SELECT name, canonical FROM canonical", ("canonical",))
def resolve_merges(v):
    return graph.resolve_merges(v.skill)


@query("routing_depth", "SELECT name, depth FROM depth", ("depth",))
def routing_depth(v):
    return graph.longest_depth(v.node, v.edge)


_REACH = """SELECT * FROM (WITH RECURSIVE c(node, below) AS (SELECT name, name FROM node
  UNION SELECT c.node, e.child FROM c JOIN edge e ON e.parent = c.below) SELECT * FROM c)"""


@query(
    "reachable_skills",
    f"""WITH c AS ({_REACH}) SELECT c.node, count(DISTINCT k.canonical) AS skills, min(k.canonical) AS first_skill
FROM c JOIN member m ON m.node = c.below JOIN canonical k ON k.name = m.skill GROUP BY c.node""",
    ("node", "edge", "member", "canonical"),
)
def reachable_skills(v):
    live = graph.resolve_merges(v.skill)
    got = graph.reachable_skills(v.node, v.edge, v.member, live)
    return got.groupBy("node").agg(F.count(F.lit(1)).alias("skills"), F.min("skill").alias("first_skill"))


@query(
    "cycle_check",
    f"""WITH c AS (SELECT * FROM (WITH RECURSIVE c(node, below) AS (SELECT parent, child FROM edge
  UNION SELECT c.node, e.child FROM c JOIN edge e ON e.parent = c.below) SELECT * FROM c))
SELECT (SELECT count(*) FROM edge) AS edges, count(*) FILTER (WHERE node = below) AS cyclic FROM c""",
    ("edge",),
)
def cycle_check(v):
    cyclic = graph.cyclic_nodes(v.edge).agg(F.count(F.lit(1)).alias("cyclic"))
    return v.edge.agg(F.count(F.lit(1)).alias("edges")).withColumn("k", F.lit(1)).join(
        cyclic.withColumn("k", F.lit(1)), "k"
    ).drop("k")


@query("infer_roots", "SELECT name FROM node WHERE is_root", ("node",))
def infer_roots(v):
    return graph.infer_roots(v.node, v.edge)


@query(
    "graph_integrity",
    """WITH kept AS (SELECT skill FROM part_dag WHERE p_size <> 7), e2 AS (SELECT * FROM edge
  UNION ALL SELECT DISTINCT brand, 'lost_' || bn FROM part_dag WHERE p_size = 13)
SELECT 'unknown_child' AS kind, parent AS at, child AS name FROM e2 WHERE child NOT IN (SELECT name FROM node)
UNION ALL SELECT 'unknown_skill', m.node, m.skill FROM member m JOIN canonical k ON k.name = m.skill
WHERE k.canonical NOT IN (SELECT skill FROM kept)
UNION ALL SELECT DISTINCT 'unknown_root', NULL, 'root_' || tn FROM part_dag""",
    ("node", "edge", "member", "canonical"),
)
def graph_integrity(v):
    """The graph with a missing child, a missing root and skills of one size left out."""
    kept = v.part_dag.where("p_size <> 7").select("skill")
    lost = v.part_dag.where("p_size = 13").select(F.col("brand").alias("parent"), F.concat(F.lit("lost_"), "bn").alias("child")).distinct()
    roots = v.node.where("is_root").select("name").unionByName(
        v.part_dag.select(F.concat(F.lit("root_"), "tn").alias("name")).distinct()
    )
    live = graph.resolve_merges(v.skill)
    return graph.integrity_defects(v.node, roots, v.edge.unionByName(lost), v.member, live, kept)


@query(
    "skill_memberships",
    "SELECT skill, string_agg(node, ',' ORDER BY node) AS nodes FROM (SELECT DISTINCT node, skill FROM member) GROUP BY skill",
    ("member",),
)
def skill_memberships(v):
    return graph.skill_memberships(v.member).select("skill", F.array_join("nodes", ",").alias("nodes"))


@query(
    "split_parent_load",
    """SELECT p.node, count(DISTINCT skill) AS direct_skills FROM (SELECT DISTINCT parent AS node FROM edge) p
LEFT JOIN member m ON m.node = p.node GROUP BY p.node""",
    ("edge", "member"),
)
def split_parent_load(v):
    return graph.split_parent_load(v.member, v.edge)


@query(
    "lexical_scorer",
    """WITH b AS (SELECT l_orderkey, skill, string_split(doc, ' ') AS d, string_split(first(doc) OVER
  (PARTITION BY l_orderkey ORDER BY pos), ' ') AS q FROM batch_part)
SELECT l_orderkey, skill, score, score >= 50 AS applicable FROM (SELECT l_orderkey, skill,
  CAST(floor(100 * len(list_intersect(q, d)) / len(list_distinct(q))) AS INTEGER) AS score FROM b)""",
    ("batch_part",),
)
def lexical_scorer(v):
    """Scores of every batch candidate against the words of its request's first part."""
    from routeloom.functions import text as tx

    words = v.batch_part.select("l_orderkey", "skill", "pos", tx.token_set(F.col("doc")).alias("d"))
    asked = words.where("pos = 1").select("l_orderkey", F.col("d").alias("q"))
    scored = words.join(asked, "l_orderkey").select(
        "l_orderkey", "skill", graph.lexical_score(F.col("q"), F.col("d")).alias("score")
    )
    return scored.withColumn("applicable", F.col("score") >= 50)


@query("route_dag", f"WITH {CHOSEN_SQL} SELECT query_id, level, name, score FROM chosen", ROUTE_VIEWS)
def route_dag(v):
    return graph.route_dag(v.route_query, v.node, v.edge)


@query(
    "routing_trace",
    f"""WITH {CHOSEN_SQL} SELECT query_id, level, CAST(NULL AS VARCHAR) AS parent, name, score FROM chosen WHERE level = 1
UNION SELECT c.query_id, c.level, p.name, c.name, c.score FROM chosen c JOIN chosen p ON p.query_id = c.query_id AND p.level = c.level - 1
  JOIN edge e ON e.parent = p.name AND e.child = c.name""",
    ROUTE_VIEWS,
)
def routing_trace(v):
    return graph.route_trace(v.route_query, v.node, v.edge)


def _result(v):
    return graph.routing_result(cut_lineage(graph.route_trace(v.route_query, v.node, v.edge)), v.node, v.edge, v.member, graph.resolve_merges(v.skill))


@query(
    "routing_result",
    f"""WITH {CHOSEN_SQL}, s AS (SELECT query_id, c.name, min((level, -score)) AS pl, bool_or(is_root) AS is_root, bool_or(c.name IN (SELECT node FROM member)) AS is_leaf
  FROM chosen c JOIN node n ON n.name = c.name GROUP BY ALL), k AS (SELECT query_id, count(*) AS candidates, md5(string_agg(skill, ',' ORDER BY skill)) AS digest FROM cand GROUP BY query_id),
r AS ({_REACH}), b AS (SELECT query_id, count(DISTINCT below) AS below FROM s JOIN r ON r.node = s.name GROUP BY query_id)
SELECT s.query_id, string_agg(name, ',' ORDER BY pl, name) FILTER (WHERE is_root) AS roots, string_agg(name, ',' ORDER BY pl, name) FILTER (WHERE NOT is_root) AS descendants,
  string_agg(name, ',' ORDER BY pl, name) FILTER (WHERE is_leaf) AS leaves, any_value(coalesce(candidates, 0)) AS candidates, any_value(digest) AS digest, any_value(below) AS below
FROM s LEFT JOIN k ON k.query_id = s.query_id JOIN b ON b.query_id = s.query_id GROUP BY s.query_id""",
    ROUTE_VIEWS,
)
def routing_result(v):
    """Selected roots, descendants and leaves in order of choice, the candidates and what lies below."""
    # Requests with the same trace have the same result: it is worked out for one of them.
    trace = cut_lineage(graph.route_trace(v.route_query, v.node, v.edge))
    alike = graph.trace_classes(trace)
    one = trace.join(alike.where("query_id = like").select("query_id"), "query_id", "left_semi")
    got = graph.routing_result(one, v.node, v.edge, v.member, graph.resolve_merges(v.skill))
    at = F.struct("level", (-F.col("score")).alias("weak"), "name")
    named = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, at))), lambda x: x["name"]), ",")
    lists = got["selected"].groupBy("query_id").agg(
        F.nullif(named(F.col("kind") == "root"), F.lit("")).alias("roots"), F.nullif(named(F.col("kind") == "descendant"), F.lit("")).alias("descendants"),
        F.nullif(named(F.col("is_leaf")), F.lit("")).alias("leaves"),
    )
    skills = got["candidates"].groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.md5(F.array_join(F.array_sort(F.collect_list("skill")), ",")).alias("digest")
    )
    below = got["below"].groupBy("query_id").agg(F.count(F.lit(1)).alias("below"))
    told = cut_lineage(lists.join(skills, "query_id", "left").join(below, "query_id")).withColumnRenamed("query_id", "like")
    return alike.join(told, "like").select(
        "query_id", "roots", "descendants", "leaves", F.coalesce("candidates", F.lit(0)).alias("candidates"), "digest", "below"
    )


@query(
    "routing_levels",
    f"""WITH {CHOSEN_SQL}, a AS (SELECT query_id, level + 1 AS level, count(DISTINCT child) AS asked FROM chosen JOIN edge ON parent = name GROUP BY ALL),
p AS (SELECT query_id, level, count(DISTINCT name) AS chosen FROM chosen GROUP BY ALL)
SELECT coalesce(a.query_id, p.query_id) AS query_id, coalesce(a.level, p.level) AS level, CASE WHEN p.level = 1 THEN (SELECT count(*) FROM node WHERE is_root) ELSE asked END AS asked,
  coalesce(chosen, 0) AS chosen FROM a FULL JOIN p ON p.query_id = a.query_id AND p.level = a.level""",
    ROUTE_VIEWS,
)
def routing_levels(v):
    """Nodes asked and chosen on every level of every request."""
    return _result(v)["levels"]


@query(
    "document_lookup",
    f"""WITH {CHOSEN_SQL} SELECT query_id, level, md5(string_agg(description, '|' ORDER BY c.name)) AS cards
FROM chosen c JOIN node n ON n.name = c.name GROUP BY query_id, level""",
    ROUTE_VIEWS,
)
def document_lookup(v):
    chosen = graph.route_dag(v.route_query, v.node, v.edge)
    cards = chosen.join(v.node.select("name", "description"), "name")
    packed = F.array_sort(F.collect_list(F.struct("name", "description")))
    return cards.groupBy("query_id", "level").agg(
        F.md5(F.array_join(F.transform(packed, lambda s: s["description"]), "|")).alias("cards")
    )


def chosen_nodes(v):
    """One request per class of words with its chosen nodes, and the class of every request (``query_id, like``)."""
    alike = graph.request_classes(v.route_query)
    asked = v.route_query.join(alike.where("query_id = like").select("query_id"), "query_id", "left_semi")
    return cut_lineage(graph.route_dag(asked, v.node, v.edge)), alike


def reviewed(v, live, chosen, k):
    """The first ``k`` candidates of every routed request (and some more) with their lexical review."""
    from routeloom.functions import text as tx

    words = v.route_query.select("query_id", "source", tx.token_set(F.col("query")).alias("q"))
    docs = words.select(F.col("source").alias("skill"), F.col("q").alias("d"))
    return graph.review_candidates(chosen, v.member, live, words, docs, 60, k)


FLOW_SQL = f"""{CHOSEN_SQL},
rev AS MATERIALIZED (SELECT c.query_id, c.skill, c.seen, CAST(floor(100 * len(list_intersect(a.q, d.q)) / len(a.q)) AS INTEGER) AS score
  FROM cand c JOIN ask a ON a.query_id = c.query_id JOIN ask d ON d.source = c.skill),
rk AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM rev WHERE score >= 60)
  WHERE rank <= 10),
src AS MATERIALIZED (SELECT query_id, k.canonical AS source FROM route_query q JOIN canonical k ON k.name = q.source)"""


def retrieved(v):
    """Requests with candidate count, nullable source rank and coverage."""
    live = cut_lineage(graph.resolve_merges(v.skill))
    chosen, alike = chosen_nodes(v)
    src = v.route_query.join(live, F.col("source") == F.col("name")).select("query_id", F.col("canonical").alias("skill"))
    src = cut_lineage(src.join(alike, "query_id", "left"))
    ranked = ranking.rank_topk(reviewed(v, live, chosen, 10), "query_id", ["seen"]).select(F.col("query_id").alias("like"), "skill", F.col("rank").alias("source_rank"))
    told = v.route_query.select(F.col("source").alias("skill"))
    held = v.member.join(live, F.col("skill") == F.col("name")).select("node", F.col("canonical").alias("skill"))
    held = cut_lineage(held.join(told, "skill", "left_semi").distinct())
    counts = graph.candidate_counts(chosen, held).withColumnRenamed("query_id", "like")
    met = chosen.select(F.col("query_id").alias("like"), F.col("name").alias("node")).distinct()
    covered = src.select("like", "skill").distinct().join(held, "skill").join(met, ["like", "node"], "left_semi")
    covered = covered.select("like", "skill", F.lit(True).alias("covered")).distinct()
    return (
        src.join(ranked, ["like", "skill"], "left")
        .join(covered, ["like", "skill"], "left")
        .join(counts, "like", "left")
        .select("query_id", "source_rank", F.coalesce("covered", F.lit(False)).alias("covered"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    )
