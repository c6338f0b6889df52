"""Catalog edit queries."""

from pyspark.sql import functions as F

from routeloom.operators import evidence, ordered, patches
from routeloom.plans.q_evidence import ALL_VIEWS, MISS_SQL, PARENTS_SQL, VIEWS, _misses, _rows, _top
from routeloom.plans.registry import query
from routeloom.session import cut_lineage


@query(
    "edit_gate",
    f"""WITH {PARENTS_SQL}, {MISS_SQL}, ed AS (SELECT parent, operation, source, target, min(query_id) AS q1, max(query_id) AS q2 FROM mr GROUP BY ALL),
fp AS (SELECT parent, min(query_id) AS q3 FROM rm GROUP BY parent), ed3 AS (SELECT ed.*, q3 FROM ed LEFT JOIN fp USING (parent)),
cited AS (SELECT DISTINCT parent, operation, source, target, q FROM (SELECT *, unnest([q1, q2, q3]) AS q FROM ed3) WHERE q IS NOT NULL),
given AS (SELECT parent, query_id FROM rm UNION SELECT rr.parent, rr.query_id FROM rr JOIN top USING (parent, a, b, relation)),
c AS (SELECT c.parent, c.operation, c.source, c.target, count(*) AS n, count(g.query_id) AS g, count(o.query_id) AS o FROM cited c
  LEFT JOIN given g ON g.parent = c.parent AND g.query_id = c.q
  LEFT JOIN (SELECT DISTINCT parent, operation, source, target, query_id FROM rm) o ON o.parent = c.parent AND o.operation = c.operation AND o.source = c.source
    AND o.target = c.target AND o.query_id = c.q GROUP BY ALL)
SELECT parent, operation, source, target, CASE WHEN n < 2 OR g < n THEN 'ids' WHEN o < n AND operation = 'add_edge' THEN 'dropped'
  WHEN o < n THEN 'unrelated' ELSE 'ok' END AS outcome FROM c""",
    ALL_VIEWS,
)
def edit_gate(v):
    """Edits cite the first and last request of their key and the first request of their parent."""
    raw = evidence.miss_rows(v.diagnosis, v.member, v.node)
    kept = cut_lineage(evidence.repeated_miss(raw))
    edits = raw.groupBy(*evidence.MISS).agg(F.min("query_id").alias("q1"), F.max("query_id").alias("q2"))
    edits = edits.join(kept.groupBy("parent").agg(F.min("query_id").alias("q3")), "parent", "left")
    edits = cut_lineage(edits.withColumn("edit_id", F.concat_ws("|", *evidence.MISS)))
    cited = edits.select("edit_id", F.explode(F.array_compact(F.array("q1", "q2", "q3"))).alias("query_id"))
    rows = cut_lineage(_rows(v))
    direct = v.member.select(F.col("node").alias("parent")).distinct()
    top = evidence.relations_topk(evidence.relation_support(rows)).join(direct, "parent", "left_semi")
    linked = rows.join(top.select(*evidence.KEY), evidence.KEY, "left_semi").select("parent", "query_id")
    given = kept.select("parent", "query_id").unionByName(linked)
    return patches.edit_gate(edits.select("edit_id", *evidence.MISS), cited, given, kept).select(*evidence.MISS, "outcome")


@query(
    "merge_gate",
    f"""WITH {PARENTS_SQL}, mg AS (SELECT parent, a, b, support, a_is_source AND b_is_source AS both_sides FROM sup WHERE relation = 'same' AND parent IN (SELECT node FROM m))
SELECT parent, a, b, CASE WHEN both_sides THEN 'ok' ELSE 'direction' END AS outcome FROM mg""",
    VIEWS,
)
def merge_gate(v):
    """Every repeated same-pair proposed as a merge citing all of its requests."""
    rows = cut_lineage(_rows(v))
    direct = v.member.select(F.col("node").alias("parent")).distinct()
    same = rows.where("relation = 'same'")
    supported = cut_lineage(evidence.relation_support(same).join(direct, "parent", "left_semi"))
    merges = supported.select(F.concat_ws("|", "parent", "a", "b").alias("edit_id"), "parent", F.col("b").alias("keep"), F.col("a").alias("remove"))
    cited = same.select(F.concat_ws("|", "parent", "a", "b").alias("edit_id"), "query_id")
    got = patches.merge_gate(merges, cited, supported, same)
    return got.select("parent", F.col("remove").alias("a"), F.col("keep").alias("b"), "outcome")


_SPLIT = """sp AS MATERIALIZED (SELECT mid AS parent, CASE WHEN p_size <= 20 THEN 'small_' || bn || '_' || tn ELSE 'large_' || bn || '_' || tn END AS child,
  CASE WHEN p_size <= 20 THEN 'Fits small parts' ELSE 'Fits large parts' END AS description, skill, p_partkey AS ord FROM part_dag WHERE p_size <= 45)"""


def _splits(v):
    """Each middle node split into small and large parts; sizes 41..45 are not its direct members."""
    small = F.col("p_size") <= 20
    return v.part_dag.where("p_size <= 45").select(
        F.col("mid").alias("parent"), F.concat_ws("_", F.when(small, "small").otherwise("large"), "bn", "tn").alias("child"),
        F.when(small, "Fits small parts").otherwise("Fits large parts").alias("description"), "skill", F.col("p_partkey").alias("ord"),
    )


@query(
    "apply_splits",
    f"""WITH {_SPLIT} SELECT node, skill, pos FROM member WHERE (node, skill) NOT IN (SELECT (parent, skill) FROM sp)
UNION ALL SELECT child, skill, ord FROM sp""",
    ("member", "part_dag"),
)
def apply_splits(v):
    return patches.apply_splits(v.node, v.edge, v.member, _splits(v))["members"].select("node", "skill", "pos")


@query(
    "split_parents",
    f"WITH {_SPLIT} SELECT parent, count(*) AS moved, count(DISTINCT child) AS children FROM sp GROUP BY parent",
    ("part_dag",),
)
def split_parents(v):
    edits = patches.apply_splits(v.node, v.edge, v.member, _splits(v))["edits"]
    return edits.groupBy(F.col("from_node").alias("parent")).agg(
        F.count(F.lit(1)).alias("moved"), F.countDistinct("to_node").alias("children")
    )


@query(
    "split_gate",
    """WITH s AS (SELECT mid AS parent, count(DISTINCT p_size <= 20) AS kids, min(n) AS smallest, count(*) AS moved FROM (SELECT *, count(*) OVER
  (PARTITION BY mid, p_size <= 20) AS n FROM part_dag WHERE p_size <= 45) GROUP BY mid),
a AS (SELECT p.mid AS parent, count(DISTINCT query_id) AS ids FROM relation r JOIN part_dag p ON p.skill = r.a WHERE relation <> 'same' GROUP BY p.mid)
SELECT s.parent, CASE WHEN kids < 2 THEN 'children' WHEN smallest < 2 THEN 'placed_once' WHEN moved < 12 THEN 'moved' WHEN coalesce(ids, 0) < 2 THEN 'linked' END AS rule
FROM s LEFT JOIN a ON a.parent = s.parent""",
    ("relation", "part_dag"),
)
def split_gate(v):
    """The size splits judged with twelve skills to move, citing the alternatives of their parts."""
    splits = cut_lineage(_splits(v))
    mids = v.part_dag.select(F.col("skill").alias("a"), F.col("mid").alias("parent"))
    alternatives = v.relation.where("relation <> 'same'").join(mids, "a").select("parent", "query_id")
    due = splits.select("parent", F.lit(12).alias("minimum_move")).distinct()
    return patches.split_gate(splits, alternatives, splits.select("parent", "skill"), alternatives, v.node, due)


@query(
    "rewire_edges",
    f"""WITH {_SPLIT}, nw AS (SELECT node, skill FROM member WHERE (node, skill) NOT IN (SELECT (parent, skill) FROM sp) UNION SELECT child, skill FROM sp)
SELECT node, count(*) AS n, min(skill) AS first_skill FROM nw GROUP BY node""",
    ("member", "part_dag"),
)
def rewire_edges(v):
    s = _splits(v)
    got = patches.rewire(
        v.member, s.select(F.col("parent").alias("node"), "skill"), s.select(F.col("child").alias("node"), "skill", F.col("ord").alias("pos"))
    )
    return got.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("skill").alias("first_skill"))


@query(
    "checkpoint_diff",
    f"""WITH {_SPLIT}, nw AS (SELECT node, skill FROM member WHERE (node, skill) NOT IN (SELECT (parent, skill) FROM sp) UNION SELECT child, skill FROM sp)
SELECT node, skill, 'removed' AS change FROM (SELECT node, skill FROM member EXCEPT SELECT node, skill FROM nw)
UNION ALL SELECT node, skill, 'added' FROM (SELECT node, skill FROM nw EXCEPT SELECT node, skill FROM member)""",
    ("member", "part_dag"),
)
def checkpoint_diff(v):
    after = patches.apply_splits(v.node, v.edge, v.member, _splits(v))["members"]
    return patches.checkpoint_diff(v.member, after, ["node", "skill"])


def _merge_list(v):
    """Same-pairs as an ordered merge list: the part with the smaller key stays."""
    keys = v.part_dag.select("skill", "p_partkey")
    pairs = v.relation.where("relation = 'same'").select("a", "b").distinct()
    pairs = pairs.join(keys.toDF("a", "ka"), "a").join(keys.toDF("b", "kb"), "b")
    first = F.col("ka") < F.col("kb")
    rows = pairs.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("remove"),
        F.least("ka", "kb").alias("k1"), F.greatest("ka", "kb").alias("k2"),
    )
    return ordered.positions(rows, [], ["k1", "k2"], "ord")


@query(
    "pick_merges",
    """WITH pr AS (SELECT DISTINCT a, b FROM relation WHERE relation = 'same'),
ml AS MATERIALIZED (SELECT row_number() OVER (ORDER BY least(p.p_partkey, q.p_partkey), greatest(p.p_partkey, q.p_partkey)) AS i,
  CASE WHEN p.p_partkey < q.p_partkey THEN a ELSE b END AS keep, CASE WHEN p.p_partkey < q.p_partkey THEN b ELSE a END AS remove FROM pr JOIN part_dag p ON p.skill = a JOIN part_dag q ON q.skill = b),
st AS (WITH RECURSIVE f(i, gone, ok) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false
  UNION ALL SELECT ml.i, CASE WHEN list_contains(gone, keep) OR list_contains(gone, remove) THEN gone ELSE list_append(gone, remove) END,
    NOT (list_contains(gone, keep) OR list_contains(gone, remove)) FROM f JOIN ml ON ml.i = f.i + 1) SELECT i FROM f WHERE ok)
SELECT ml.i AS ord, keep, remove FROM ml JOIN st ON st.i = ml.i""",
    ("relation", "part_dag"),
)
def pick_merges(v):
    """Accepted merges of the whole ordered list, as a fold over it would accept them."""
    return patches.pick_merges(_merge_list(v)).select("ord", "keep", "remove")


@query(
    "apply_merges",
    """WITH k AS (SELECT p.leaf, min(p.p_partkey) AS head FROM part_dag p GROUP BY p.leaf), c AS (SELECT p.skill, 'part_' || head AS live FROM part_dag p JOIN k ON k.leaf = p.leaf)
SELECT node, c.live AS skill, min(pos) AS pos FROM member m JOIN c ON c.skill = m.skill GROUP BY ALL""",
    ("member", "part_dag"),
)
def apply_merges(v):
    """All parts of one leaf merged into its first part."""
    heads = v.part_dag.groupBy("leaf").agg(F.min("p_partkey").alias("head"))
    rows = v.part_dag.join(heads, "leaf").where("p_partkey <> head").select(
        F.concat(F.lit("part_"), F.col("head").cast("string")).alias("keep"), F.col("skill").alias("remove"), F.col("p_partkey").alias("ord")
    )
    base = v.skill.select("skill", "description", F.lit(None).cast("string").alias("merged_into"))
    return patches.apply_merges(base, v.member, patches.pick_merges(rows))[1]


@query(
    "apply_rewrites",
    f"""WITH {MISS_SQL}, fw AS (SELECT source AS skill, arg_min('new ' || source || ' at ' || parent, parent) AS replacement FROM rm WHERE operation = 'rewrite_skill' GROUP BY source)
SELECT s.skill, s.description, coalesce(replacement, s.description) AS after, replacement IS NOT NULL AS changed FROM skill s LEFT JOIN fw ON fw.skill = s.skill""",
    ("diagnosis", "member", "node", "skill"),
)
def apply_rewrites(v):
    rows = _misses(v).where("operation = 'rewrite_skill'").select(
        F.col("source").alias("skill"), F.concat(F.lit("new "), "source", F.lit(" at "), "parent").alias("replacement"), F.col("parent").alias("ord")
    ).distinct()
    return patches.apply_rewrites(v.skill.select("skill", "description"), "skill", rows)


@query(
    "apply_add_edges",
    """SELECT node, skill, min(pos) AS pos FROM (SELECT node, skill, pos FROM member UNION ALL SELECT target, source, query_id FROM diagnosis d
  WHERE operation = 'add_edge' AND (target, source) NOT IN (SELECT (node, skill) FROM member)) GROUP BY ALL""",
    ("diagnosis", "member"),
)
def apply_add_edges(v):
    added = v.diagnosis.where("operation = 'add_edge'").select(F.col("target").alias("node"), F.col("source").alias("skill"), F.col("query_id").alias("pos"))
    return patches.apply_add_edges(v.member, added)[0]


_OPEN = f"""{_SPLIT}, op AS MATERIALIZED (SELECT node, m.skill, pos, row_number() OVER (PARTITION BY node ORDER BY pos, m.skill) AS n FROM member m JOIN skill s ON s.skill = m.skill
  WHERE merged_into IS NULL AND node IN (SELECT parent FROM edge) AND (node, m.skill) NOT IN (SELECT (parent, skill) FROM sp))"""


def _pending(v):
    seeded = _splits(v).select(F.col("parent").alias("node"), "skill")
    return patches.pending_partitions(v.member, v.edge, seeded, v.skill)


@query("partition_batches", f"WITH {_OPEN} SELECT node, skill, (n - 1) // 8 AS batch FROM op", ("member", "edge", "skill", "part_dag"))
def partition_batches(v):
    return _pending(v).select("node", "skill", "batch")


@query(
    "complete_partitions",
    f"""WITH {_OPEN}, mv AS (SELECT op.node, op.skill, p.mid AS child FROM op JOIN part_dag p ON p.skill = op.skill WHERE p.p_retailprice >= 950)
SELECT node, skill, 'kept' AS state FROM (SELECT node, skill FROM member EXCEPT SELECT node, skill FROM mv) WHERE node IN (SELECT node FROM op)
UNION ALL SELECT child, skill, 'patch of ' || node FROM mv""",
    ("member", "edge", "skill", "part_dag"),
)
def complete_partitions(v):
    """Open skills go to their middle node, cheap ones stay at the parent."""
    open_rows = cut_lineage(_pending(v))
    places = v.part_dag.select("skill", "mid", "p_retailprice")
    assigned = open_rows.join(places, "skill").select(
        "node", "skill", F.array("mid").alias("children"), (F.col("p_retailprice") < 950).alias("keep")
    )
    members, patch = patches.complete_partitions(v.member, assigned)
    touched = open_rows.select("node").distinct()
    stay = members.join(touched, "node", "left_semi").select("node", "skill", F.lit("kept").alias("state"))
    return stay.unionByName(patch.select(F.col("to_node").alias("node"), "skill", F.concat(F.lit("patch of "), "from_node").alias("state")))


@query(
    "comembership_fill",
    """WITH pl AS (SELECT typ AS parent, skill, CASE WHEN p_size <= 20 THEN 'small' ELSE 'large' END AS child FROM part_dag WHERE p_size <= 40),
x AS MATERIALIZED (SELECT p.typ AS parent, a, b, row_number() OVER (PARTITION BY p.typ ORDER BY query_id, a, b) AS n
  FROM relation JOIN part_dag p ON p.skill = a WHERE relation = 'same')
SELECT parent, unnest(map_keys(state)) AS skill, unnest(map_values(state)) AS child FROM (SELECT parent, arg_max(state, n) AS state FROM (
  WITH RECURSIVE f(parent, n, state) AS (
    SELECT parent, CAST(0 AS BIGINT), map(list(skill), list(child)) FROM pl GROUP BY parent
    UNION ALL SELECT parent, m, CASE WHEN ka IS NOT NULL AND kb IS NULL THEN map_concat(state, map([b], [ka]))
      WHEN ka IS NULL AND kb IS NOT NULL THEN map_concat(state, map([a], [kb])) ELSE state END
    FROM (SELECT f.parent, f.state, x.n AS m, a, b, map_extract(state, a)[1] AS ka, map_extract(state, b)[1] AS kb
      FROM f JOIN x ON x.parent = f.parent AND x.n = f.n + 1))
  SELECT * FROM f) GROUP BY parent)""",
    ("relation", "part_dag"),
)
def comembership_fill(v):
    """Big parts join the child of a same-pair partner, pair after pair."""
    kid = F.when(F.col("p_size") <= 20, "small").otherwise("large")
    placement = v.part_dag.where("p_size <= 40").select(F.col("typ").alias("parent"), "skill", kid.alias("child"))
    types = v.part_dag.select(F.col("skill").alias("a"), F.col("typ").alias("parent"))
    pairs = v.relation.where("relation = 'same'").join(types, "a").select(
        "parent", F.struct("query_id", "a", "b").alias("ord"), F.col("a").alias("keep"), F.col("b").alias("remove")
    )
    return patches.comembership_fill(pairs, placement, v.part_dag.select(F.col("typ").alias("parent"), "skill"))[0]


@query("partition_seed")
def partition_seed(v):
    """Seed relations of parents with enough alternatives (greedy; budget checked in the tests)."""
    top = cut_lineage(_top(v))
    due = evidence.split_eligibility(top, v.skill).where("eligible").select("parent")
    return patches.partition_seed(top.join(due, "parent", "left_semi"))
