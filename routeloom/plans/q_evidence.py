"""Evidence aggregation queries."""

from pyspark.sql import functions as F

from routeloom.operators import evidence, graph
from routeloom.plans.registry import query

ALT = "'alternative_same_position'"
PARENTS_SQL = f"""m AS MATERIALIZED (SELECT DISTINCT node, skill FROM member),
pr AS MATERIALIZED (SELECT DISTINCT a, b, relation, split_parent FROM relation),
sh AS MATERIALIZED (SELECT pr.*, x.node AS parent, coalesce(d.depth, -1) AS depth FROM pr JOIN m x ON x.skill = a
  JOIN m y ON y.skill = b AND y.node = x.node LEFT JOIN depth d ON d.name = x.node),
par AS MATERIALIZED (SELECT a, b, relation, split_parent, parent FROM (SELECT *, rank() OVER
  (PARTITION BY a, b, relation, split_parent ORDER BY depth DESC) AS r FROM sh) WHERE r = 1
  UNION ALL SELECT pr.*, pr.split_parent FROM pr WHERE relation = {ALT} AND split_parent IN (SELECT name FROM node)
    AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.a = pr.a AND sh.b = pr.b AND sh.relation = pr.relation AND sh.split_parent = pr.split_parent)
  UNION ALL SELECT DISTINCT pr.*, m.node FROM pr JOIN m ON m.skill IN (pr.a, pr.b) WHERE relation = 'same'
    AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.a = pr.a AND sh.b = pr.b AND sh.relation = pr.relation AND sh.split_parent = pr.split_parent)),
rr AS MATERIALIZED (SELECT r.*, p.parent FROM relation r JOIN par p ON p.a = r.a AND p.b = r.b AND p.relation = r.relation
  AND p.split_parent = r.split_parent),
sup AS MATERIALIZED (SELECT parent, a, b, relation, count(DISTINCT query_id) AS support, max(source = a) AS a_is_source,
  max(source = b) AS b_is_source FROM rr GROUP BY ALL HAVING count(DISTINCT query_id) >= 2),
top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY support DESC, a, b, relation) AS rank
  FROM sup) WHERE rank <= 160 AND parent IN (SELECT node FROM m))"""
MISS_SQL = """mr AS MATERIALIZED (SELECT d.*, d.target AS parent FROM diagnosis d WHERE operation IN ('rewrite_node', 'add_edge')
    AND target IN (SELECT name FROM node)
  UNION ALL SELECT d.*, x.node FROM diagnosis d JOIN (SELECT DISTINCT node, skill FROM member) x ON x.skill = d.source
  WHERE operation = 'rewrite_skill'),
rm AS MATERIALIZED (SELECT *, rows FROM (SELECT *, count(*) OVER (PARTITION BY parent, operation, source, target) AS rows FROM mr)
  WHERE rows >= 2)"""
VIEWS = ("relation", "member", "depth", "node")
ALL_VIEWS = (*VIEWS, "diagnosis")


def _rows(v):
    """Repeated relation rows with their parents (pairs seen once support nothing)."""
    depth = graph.longest_depth(v.node, v.edge)
    often = evidence.repeated_relations(v.relation)
    return evidence.relation_rows(often, evidence.evidence_parents(often, v.member, depth, v.node))


def _top(v):
    direct = v.member.select(F.col("node").alias("parent")).distinct()
    return evidence.relations_topk(evidence.relation_support(_rows(v))).join(direct, "parent", "left_semi")


def _misses(v):
    return evidence.repeated_miss(evidence.miss_rows(v.diagnosis, v.member, v.node))


@query("evidence_parents", f"WITH {PARENTS_SQL} SELECT * FROM par", VIEWS)
def evidence_parents(v):
    return evidence.evidence_parents(v.relation, v.member, graph.longest_depth(v.node, v.edge), v.node)


@query(
    "relation_support",
    f"""WITH {PARENTS_SQL}, k AS (SELECT rr.* FROM rr JOIN sup USING (parent, a, b, relation)),
al AS (SELECT parent, a, b, relation, string_agg(query_id, ',' ORDER BY query_id) AS all_ids FROM (SELECT DISTINCT parent, a, b, relation, query_id FROM k) GROUP BY ALL),
so AS (SELECT parent, a, b, relation, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT parent, a, b, relation, source FROM k) GROUP BY ALL),
ids AS (SELECT parent, a, b, relation, string_agg(query_id, ',' ORDER BY query_id) AS ids FROM (SELECT *, row_number() OVER
  (PARTITION BY parent, a, b, relation ORDER BY query_id) AS n FROM (SELECT DISTINCT parent, a, b, relation, query_id FROM k)) WHERE n <= 2 GROUP BY ALL),
rs AS (SELECT parent, a, b, relation, string_agg(reason, ',' ORDER BY query_id) AS reasons FROM (SELECT *, row_number() OVER
  (PARTITION BY parent, a, b, relation ORDER BY query_id) AS n FROM k) WHERE n <= 3 GROUP BY ALL),
ds AS (SELECT parent, a, b, relation, string_agg(distinction, ',' ORDER BY distinction) AS distinctions FROM (SELECT *, row_number() OVER
  (PARTITION BY parent, a, b, relation ORDER BY distinction) AS n FROM (SELECT DISTINCT parent, a, b, relation, distinction FROM k
   WHERE distinction <> '')) WHERE n <= 5 GROUP BY ALL)
SELECT parent, a, b, relation, support, a_is_source, b_is_source, (SELECT count(DISTINCT source) FROM k WHERE k.parent = sup.parent
  AND k.a = sup.a AND k.b = sup.b AND k.relation = sup.relation) AS n_sources, ids AS first_ids, all_ids AS ids, coalesce(sources, '') AS sources,
  reasons, coalesce(distinctions, '') AS distinctions
FROM sup JOIN ids USING (parent, a, b, relation) JOIN al USING (parent, a, b, relation) JOIN so USING (parent, a, b, relation) JOIN rs USING (parent, a, b, relation) LEFT JOIN ds USING (parent, a, b, relation)""",
    VIEWS,
)
def relation_support(v):
    rows = _rows(v)
    got = evidence.relation_details(rows, evidence.relation_support(rows))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return got.select(
        *evidence.KEY, "support", "a_is_source", "b_is_source", "n_sources",
        F.array_join(F.col("first_ids").cast("array<string>"), ",").alias("first_ids"),
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), text("sources"), text("reasons"), text("distinctions"),
    )


@query("relations_topk", f"WITH {PARENTS_SQL} SELECT parent, a, b, relation, support, rank FROM top", VIEWS)
def relations_topk(v):
    return _top(v).select(*evidence.KEY, "support", "rank")


@query(
    "relation_digest",
    f"""WITH {PARENTS_SQL} SELECT parent, a, b, relation, support, shown FROM (SELECT *, row_number() OVER (PARTITION BY parent
  ORDER BY relation <> {ALT}, support DESC, a, b) AS shown FROM top) WHERE shown <= 40""",
    VIEWS,
)
def relation_digest(v):
    return evidence.relation_digest(_top(v), 40).select(*evidence.KEY, "support", "shown")


@query(
    "compact_evidence",
    f"""WITH {PARENTS_SQL}, d AS (SELECT parent, a, b, relation, support, a_is_source, b_is_source, shown FROM (SELECT *, row_number() OVER (PARTITION BY parent
  ORDER BY relation <> {ALT}, support DESC, a, b) AS shown FROM top) WHERE shown <= 40),
i AS (SELECT parent, a, b, relation, min(query_id) AS lo, min(query_id) FILTER (WHERE rk = 2) AS hi FROM (SELECT *, dense_rank() OVER (PARTITION BY parent, a, b, relation ORDER BY query_id) AS rk
  FROM rr JOIN d USING (parent, a, b, relation)) GROUP BY ALL)
SELECT d.*, lo || ',' || hi AS ids, concat_ws(',', CASE WHEN a_is_source THEN a END, CASE WHEN b_is_source THEN b END) AS directions, left(x.description, 20) AS a_text, left(y.description, 20) AS b_text,
  '' AS reason, '' AS distinction FROM d JOIN i USING (parent, a, b, relation) JOIN skill x ON x.skill = d.a JOIN skill y ON y.skill = d.b""",
    (*VIEWS, "skill"),
)
def compact_evidence(v):
    """What a prompt shows of the evidence: few relations, two request ids, the pair's own directions, cut texts, no reasons."""
    depth = graph.longest_depth(v.node, v.edge)
    ev = evidence.parent_evidence(v.relation, v.diagnosis, v.member, depth, v.node, v.skill)
    return evidence.compact_evidence(ev, v.skill, 40, 20)


@query(
    "repeated_miss",
    f"WITH {MISS_SQL} SELECT parent, operation, source, target, query_id, rows FROM rm",
    ("diagnosis", "member", "node"),
)
def repeated_miss(v):
    return _misses(v).select(*evidence.MISS, "query_id", "rows")


@query(
    "miss_sample",
    f"""WITH {MISS_SQL} SELECT parent, operation, source, target, query_id, sample_no FROM (SELECT *, row_number() OVER
  (PARTITION BY parent, operation, source, target ORDER BY query_id) AS sample_no FROM rm) WHERE sample_no <= 3""",
    ("diagnosis", "member", "node"),
)
def miss_sample(v):
    return evidence.miss_sample(_misses(v)).select(*evidence.MISS, "query_id", "sample_no")


ELIG_SQL = f"""al AS MATERIALIZED (SELECT * FROM top WHERE relation = {ALT}),
en AS (SELECT parent, count(DISTINCT x) AS n_skills FROM (SELECT parent, a AS x FROM al UNION ALL SELECT parent, b FROM al) GROUP BY parent),
el AS MATERIALIZED (SELECT al.parent, count(*) AS alternatives, any_value(n_skills) AS n_skills, sum(support)::BIGINT AS score,
  count(*) >= 8 AND any_value(n_skills) >= 12 AS eligible,
  CASE WHEN count(*) >= 8 AND any_value(n_skills) >= 12 THEN greatest(12, CAST(ceil(any_value(n_skills) * 60 / 100) AS INTEGER)) ELSE 0 END AS minimum_move
  FROM al JOIN en ON en.parent = al.parent GROUP BY al.parent)"""


@query("split_eligibility", f"WITH {PARENTS_SQL}, {ELIG_SQL} SELECT * FROM el", VIEWS)
def split_eligibility(v):
    return evidence.split_eligibility(_top(v), v.skill)


@query(
    "split_parent_topk",
    f"""WITH {PARENTS_SQL}, {ELIG_SQL}, ch AS (SELECT parent FROM el WHERE eligible ORDER BY score DESC, parent DESC LIMIT 5)
SELECT parent, score, parent IN (SELECT parent FROM ch) AS split_required,
  CASE WHEN parent IN (SELECT parent FROM ch) THEN minimum_move ELSE 0 END AS minimum_move FROM el""",
    VIEWS,
)
def split_parent_topk(v):
    got = evidence.select_split_parents(evidence.split_eligibility(_top(v), v.skill), 5)
    return got.select("parent", "score", "split_required", "minimum_move")


INV_SQL = """nm AS MATERIALIZED (SELECT parent, source AS skill FROM rm UNION SELECT parent, a FROM top UNION SELECT parent, b FROM top),
inv AS MATERIALIZED (SELECT nm.parent, nm.skill, EXISTS (SELECT 1 FROM m WHERE m.node = nm.parent AND m.skill = nm.skill) AS is_direct,
  (SELECT count(*) FROM m WHERE m.skill = nm.skill) AS memberships FROM nm)"""


@query("involved_skills", f"WITH {PARENTS_SQL}, {MISS_SQL}, {INV_SQL} SELECT * FROM inv", ALL_VIEWS)
def involved_skills(v):
    return evidence.involved_skills(_top(v), _misses(v), v.skill, v.member)


SUMMARY_SQL = f"""{PARENTS_SQL}, {MISS_SQL}, {ELIG_SQL}, {INV_SQL},
dm AS (SELECT node AS parent, count(DISTINCT skill) AS direct_skills FROM m GROUP BY node),
tr AS (SELECT parent, count(*) AS relations FROM top GROUP BY parent), tm AS (SELECT parent, count(*) AS misses FROM rm GROUP BY parent),
ti AS (SELECT parent, count(*) AS involved FROM inv GROUP BY parent),
summary AS MATERIALIZED (SELECT dm.parent, direct_skills, coalesce(relations, 0) AS relations, coalesce(misses, 0) AS misses, coalesce(involved, 0) AS involved,
  coalesce(eligible, false) AS split_required, coalesce(minimum_move, 0) AS minimum_move
FROM dm LEFT JOIN tr USING (parent) LEFT JOIN tm USING (parent) LEFT JOIN ti USING (parent) LEFT JOIN el USING (parent)
WHERE relations IS NOT NULL OR misses IS NOT NULL)"""


@query("parent_evidence", f"WITH {SUMMARY_SQL} SELECT * FROM summary", ALL_VIEWS)
def parent_evidence(v):
    depth = graph.longest_depth(v.node, v.edge)
    return evidence.parent_evidence(v.relation, v.diagnosis, v.member, depth, v.node, v.skill)["summary"]


@query(
    "typed_evidence_filter",
    f"""WITH {PARENTS_SQL}, {MISS_SQL}, s AS (SELECT * FROM top WHERE relation = 'same')
SELECT parent, count(*) AS skills, min(skill) AS first_skill FROM (SELECT parent, source AS skill FROM rm WHERE parent IN (SELECT node FROM m)
  UNION SELECT parent, a FROM s UNION SELECT parent, b FROM s) GROUP BY parent""",
    ALL_VIEWS,
)
def typed_evidence_filter(v):
    direct = v.member.select(F.col("node").alias("parent")).distinct()
    _, _, names = evidence.typed_evidence(_top(v), _misses(v).join(direct, "parent", "left_semi"))
    return names.groupBy("parent").agg(F.count(F.lit(1)).alias("skills"), F.min("skill").alias("first_skill"))


@query(
    "shared_membership",
    """WITH m AS (SELECT DISTINCT node, skill FROM member), p AS (SELECT DISTINCT a, b FROM relation)
SELECT a, b, x.node FROM p JOIN m x ON x.skill = a JOIN m y ON y.skill = b AND y.node = x.node""",
    ("relation", "member"),
)
def shared_membership(v):
    placed = v.member.select("node", "skill").distinct()
    left = placed.select("node", F.col("skill").alias("a"))
    right = placed.select("node", F.col("skill").alias("b"))
    return v.relation.select("a", "b").distinct().join(left, "a").join(right, ["b", "node"], "left_semi").select("a", "b", "node")


@query(
    "diagnosis_counts",
    """SELECT 'operation' AS kind, operation AS name, count(*) AS n FROM diagnosis GROUP BY operation
UNION ALL SELECT 'relation', relation, count(*) FROM relation GROUP BY relation""",
    ("diagnosis", "relation"),
)
def diagnosis_counts(v):
    ops = v.diagnosis.groupBy(F.col("operation").alias("name")).count().withColumn("kind", F.lit("operation"))
    rels = v.relation.groupBy(F.col("relation").alias("name")).count().withColumn("kind", F.lit("relation"))
    return ops.unionByName(rels).select("kind", "name", F.col("count").alias("n"))


_PROPOSED = """pp AS MATERIALIZED (SELECT CASE WHEN source = b THEN b ELSE a END AS keep, CASE WHEN source = b THEN a ELSE b END AS remove,
  query_id, query_id AS ord FROM relation WHERE relation = 'same'),
mc AS MATERIALIZED (SELECT least(keep, remove) AS x, greatest(keep, remove) AS y, arg_min(keep, ord) AS keep, arg_min(remove, ord) AS remove,
  count(DISTINCT query_id) AS evidence FROM pp GROUP BY 1, 2)"""


def _merge_candidates(v):
    flip = F.col("source") == F.col("b")
    proposed = v.relation.where("relation = 'same'").select(
        F.when(flip, F.col("b")).otherwise(F.col("a")).alias("keep"),
        F.when(flip, F.col("a")).otherwise(F.col("b")).alias("remove"),
        "query_id",
        F.col("query_id").alias("ord"),
    )
    return evidence.merge_candidates(proposed)


@query("merge_candidates", f"WITH {_PROPOSED} SELECT * FROM mc", ("relation",))
def merge_candidates(v):
    return _merge_candidates(v)


@query(
    "pair_verdict",
    f"""WITH {_PROPOSED} SELECT x, y, x AS keep, y AS remove, evidence FROM mc JOIN part_dag p ON p.skill = x JOIN part_dag q ON q.skill = y
WHERE p.p_name = q.p_name""",
    ("relation",),
)
def pair_verdict(v):
    """A pair is verified where both names read the same; the smaller name stays."""
    names = v.part_dag.select("skill", "p_name")
    verdicts = (
        _merge_candidates(v).select("x", "y")
        .join(names.toDF("x", "nx"), "x").join(names.toDF("y", "ny"), "y")
        .select(F.col("y").alias("a"), F.col("x").alias("b"), (F.col("nx") == F.col("ny")).alias("equivalent"), F.col("x").alias("keep"))
    )
    return evidence.pair_verdict(_merge_candidates(v), verdicts)
