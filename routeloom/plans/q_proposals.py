"""Proposals built from the evidence of every parent, judged, and applied as one revision."""

from pyspark.sql import functions as F

from routeloom.operators import evidence, graph, ordered, proposals
from routeloom.plans.q_evidence import ALL_VIEWS, SUMMARY_SQL
from routeloom.plans.registry import query
from routeloom.session import cut_lineage

CLASSES = 24
ALT = evidence.ALTERNATIVE

#: What a proposal can be made of, per parent, and the rule that its planted fault breaks.
MATERIAL_SQL = f"""{SUMMARY_SQL},
shown AS MATERIALIZED (SELECT rr.*, a_is_source AND b_is_source AS both_sides FROM rr JOIN top USING (parent, a, b, relation)),
rwk AS (SELECT parent, source, min(query_id) AS lo, max(query_id) AS hi FROM rm WHERE operation = 'rewrite_skill' GROUP BY ALL),
rw AS (SELECT parent, min(source) AS s, arg_min(lo, source) AS lo, arg_min(hi, source) AS hi FROM rwk GROUP BY parent),
adk AS (SELECT parent, source, min(query_id) AS lo, max(query_id) AS hi FROM rm WHERE operation = 'add_edge' GROUP BY ALL),
ad AS (SELECT parent, min(source) AS s, arg_min(lo, source) AS lo, arg_min(hi, source) AS hi FROM adk GROUP BY parent),
mgk AS (SELECT parent, a, b, both_sides, min(query_id) AS lo, max(query_id) AS hi FROM shown WHERE relation = 'same' GROUP BY ALL),
mg AS (SELECT parent, min({{'a': a, 'b': b, 'lo': lo, 'hi': hi}}) AS m FROM mgk WHERE both_sides GROUP BY parent),
os AS (SELECT parent, min({{'a': a, 'b': b, 'lo': lo, 'hi': hi}}) AS o FROM mgk WHERE NOT both_sides GROUP BY parent),
al2 AS (SELECT parent, min(query_id) AS alo, max(query_id) AS ahi FROM shown WHERE relation = '{ALT}' GROUP BY parent),
su AS (SELECT parent, min(query_id) AS slo, max(query_id) AS shi FROM (SELECT parent, query_id FROM shown UNION ALL SELECT parent, query_id FROM rm) GROUP BY parent),
cd AS (SELECT parent, list_sort(list_distinct(list(x))) AS cands FROM (SELECT parent, a AS x FROM top UNION ALL SELECT parent, b FROM top) GROUP BY parent),
mt AS MATERIALIZED (SELECT s.parent, s.split_required, row_number() OVER (ORDER BY s.parent) AS n, greatest(4, s.minimum_move) AS k, cands,
    rw.s AS rw, rw.lo AS rlo, ad.s AS ad, ad.lo AS dlo, m.a AS ma, m.b AS mb, m.lo AS mlo, o.a AS oa, alo, ahi, slo, shi, coalesce(len(cands) >= greatest(4, s.minimum_move) AND alo < ahi, false) AS sp
  FROM summary s LEFT JOIN rw ON rw.parent = s.parent LEFT JOIN ad ON ad.parent = s.parent LEFT JOIN mg ON mg.parent = s.parent LEFT JOIN os ON os.parent = s.parent
  LEFT JOIN al2 ON al2.parent = s.parent LEFT JOIN su ON su.parent = s.parent LEFT JOIN cd ON cd.parent = s.parent),
mo AS MATERIALIZED (SELECT mt.*, n % {CLASSES} AS c,
    EXISTS (SELECT 1 FROM rm WHERE rm.parent = mt.parent AND operation = 'rewrite_skill' AND source = rw AND query_id = alo) AS r_own,
    EXISTS (SELECT 1 FROM rm WHERE rm.parent = mt.parent AND operation = 'add_edge' AND source = ad AND query_id = alo) AS d_own,
    EXISTS (SELECT 1 FROM shown h WHERE h.parent = mt.parent AND relation = 'same' AND h.a = ma AND h.b = mb AND query_id = alo) AS m_own,
    (SELECT count(DISTINCT query_id) FROM shown h WHERE h.parent = mt.parent AND relation = '{ALT}' AND query_id IN (slo, shi)) AS s_alt FROM mt),
jd AS MATERIALIZED (SELECT *, CASE c WHEN 1 THEN 'shape' WHEN 21 THEN 'json' WHEN 19 THEN 'text' WHEN 20 THEN CASE WHEN slo < shi THEN 'unrelated' ELSE 'ids' END
  WHEN 2 THEN CASE WHEN rw IS NOT NULL THEN 'text' END WHEN 3 THEN CASE WHEN rw IS NOT NULL THEN 'scope' END WHEN 4 THEN CASE WHEN rw IS NOT NULL THEN 'ids' END
  WHEN 5 THEN CASE WHEN rw IS NULL OR alo IS NULL THEN NULL WHEN alo = rlo THEN 'ids' WHEN NOT r_own THEN 'unrelated' END
  WHEN 6 THEN CASE WHEN ad IS NOT NULL THEN 'scope' END WHEN 7 THEN CASE WHEN ad IS NOT NULL AND alo = dlo THEN 'ids' END
  WHEN 8 THEN CASE WHEN ma IS NOT NULL THEN 'scope' END WHEN 9 THEN CASE WHEN oa IS NOT NULL THEN 'direction' END
  WHEN 10 THEN CASE WHEN ma IS NULL OR alo IS NULL THEN NULL WHEN alo = mlo THEN 'ids' WHEN NOT m_own THEN 'unrelated' END
  WHEN 11 THEN CASE WHEN sp THEN 'children' END WHEN 12 THEN CASE WHEN sp THEN 'child_name' END WHEN 13 THEN CASE WHEN sp THEN 'child_name' END
  WHEN 14 THEN CASE WHEN sp THEN 'child_name' END WHEN 15 THEN CASE WHEN sp THEN 'fits' END WHEN 16 THEN CASE WHEN sp THEN 'placed_once' END
  WHEN 17 THEN CASE WHEN sp AND k > 4 THEN 'moved' END WHEN 18 THEN CASE WHEN sp AND split_required THEN 'split_required' END
  WHEN 22 THEN CASE WHEN sp THEN 'child_shape' END WHEN 23 THEN CASE WHEN NOT sp THEN NULL WHEN slo = shi THEN 'ids' WHEN s_alt < 2 THEN 'linked' END END AS rule FROM mo)"""


def _round(v):
    depth = graph.longest_depth(v.node, v.edge)
    return evidence.parent_evidence(v.relation, v.diagnosis, v.member, depth, v.node, v.skill)


def _replies(ev):
    """One reply per parent with evidence (``parent, reply``), the fault by its place among the parents.

    1 extra section, 2 to 5 rewrite (blank, unknown skill, one id, foreign id), 6 and 7 edge (other node,
    foreign id: dropped), 8 to 10 merge (with itself, seen from one side, foreign id), 11 to 17, 22 and 23
    split (one child, bad name, name taken, name twice, no Fits, placed twice, too few, extra key, no
    alternative cited), 18 no split, 19 and 20 rewrite of the parent (blank, unrelated), 21 cut off.
    """
    span = [F.min("query_id").alias("lo"), F.max("query_id").alias("hi")]
    shown = ev["rows"]

    def least(rows, keys, out):
        per = rows.groupBy("parent", *keys).agg(*span)
        return per.groupBy("parent").agg(F.min(F.struct(*keys, "lo", "hi")).alias(out))

    miss = lambda op, out: least(ev["misses"].where(F.col("operation") == op), ["source"], out)
    both = ev["relations"].where("relation = 'same'").select("parent", "a", "b", "relation", (F.col("a_is_source") & F.col("b_is_source")).alias("both"))
    same = shown.join(both, ["parent", "a", "b", "relation"])
    ends = ev["relations"].select("parent", F.explode(F.array("a", "b")).alias("s"))
    supplied = shown.select("parent", "query_id").unionByName(ev["misses"].select("parent", "query_id"))
    rows = ordered.positions(ev["summary"].select("parent", "split_required", "minimum_move"), [], ["parent"], "n")
    parts = [
        miss("rewrite_skill", "rw"), miss("add_edge", "ad"), least(same.where("both"), ["a", "b"], "mg"), least(same.where("not both"), ["a", "b"], "os"),
        shown.where(F.col("relation") == ALT).groupBy("parent").agg(F.min("query_id").alias("alo"), F.max("query_id").alias("ahi")),
        supplied.groupBy("parent").agg(F.min("query_id").alias("slo"), F.max("query_id").alias("shi")),
        ends.groupBy("parent").agg(F.array_sort(F.collect_set("s")).alias("cands")),
    ]
    for part in parts:
        rows = rows.join(part, "parent", "left")
    rows = rows.withColumns({"c": F.col("n") % CLASSES, "k": F.greatest(F.lit(4), "minimum_move")})
    c, alo = F.col("c"), F.col("alo")
    foreign = lambda field, own: F.when((c == own) & alo.isNotNull(), F.array(F.col(f"{field}.lo"), alo)).otherwise(F.array(F.col(f"{field}.lo"), F.col(f"{field}.hi")))
    rewrite = F.struct(
        F.when(c == 3, "nobody").otherwise(F.col("rw.source")).alias("skill_name"), F.when(c == 2, " ").otherwise(F.concat(F.lit("new "), "rw.source")).alias("replacement_description"),
        F.when(c == 4, F.array("rw.lo")).otherwise(foreign("rw", 5)).alias("evidence_query_ids"),
    )
    edge = F.struct(F.col("ad.source").alias("skill_name"), F.when(c == 6, "elsewhere").otherwise(F.col("parent")).alias("target_node"), foreign("ad", 7).alias("evidence_query_ids"))
    sided = (c == 9) & F.col("os").isNotNull()
    merge = F.struct(
        F.when(sided, F.col("os.a")).otherwise(F.col("mg.a")).alias("keep_skill"),
        F.when(sided, F.col("os.b")).when(c == 8, F.col("mg.a")).otherwise(F.col("mg.b")).alias("remove_skill"),
        F.when(sided, F.array("os.lo", "os.hi")).otherwise(foreign("mg", 10)).alias("evidence_query_ids"),
    )
    count = F.when(c == 17, 4).otherwise(F.col("k"))
    half = F.floor(count / 2).cast("int")
    first, rest = F.slice("cands", F.lit(1), half), F.slice("cands", half + 1, count - half)
    num = F.col("n").cast("string")

    def child(name, moves, at):
        told = F.when((c == 12) & F.lit(at == 0), "Not Snake").when((c == 13) & F.lit(at == 0), F.col("parent")).when(c == 14, F.concat(F.lit("kid_a_"), num)).otherwise(name)
        moved = F.when((c == 16) & F.lit(at == 1), F.concat(moves, F.slice("cands", 1, 1))).otherwise(moves)
        fields = F.struct(told.alias("name"), F.when(c == 15, "none").otherwise("It Fits here").alias("description"), moved.alias("move_skill_names"))
        more = F.struct(told.alias("name"), F.lit("Fits").alias("description"), moved.alias("move_skill_names"), F.lit(1).alias("extra"))
        return F.when((c == 22) & F.lit(at == 1), F.to_json(more)).otherwise(F.to_json(fields))

    kids = F.array(child(F.concat(F.lit("kid_a_"), num), first, 0), child(F.concat(F.lit("kid_b_"), num), rest, 1))
    kids = F.when(c == 11, F.slice(kids, 1, 1)).otherwise(kids)
    cites = F.when(c == 23, F.array("slo", "shi")).otherwise(F.array("alo", "ahi"))
    can = F.coalesce((F.size("cands") >= F.col("k")) & (F.col("alo") < F.col("ahi")), F.lit(False)) & ~((c == 18) & F.col("split_required"))
    split = F.concat(
        F.lit('{"parent_node":"'), "parent", F.lit('","children":['), F.array_join(kids, ","), F.lit('],"evidence_query_ids":['),
        F.array_join(cites.cast("array<string>"), ","), F.lit("]}"),
    )
    node = F.when(c == 19, F.to_json(F.struct(F.lit(" ").alias("replacement_description"), F.array("slo", "shi").alias("evidence_query_ids"))))
    node = node.when(c == 20, F.to_json(F.struct(F.lit("x").alias("replacement_description"), F.array("slo", "shi").alias("evidence_query_ids")))).otherwise("null")
    listed = lambda cond, item: F.when(cond, F.concat(F.lit("["), F.to_json(item), F.lit("]"))).otherwise("[]")
    body = F.concat(
        F.lit('{"parent_rewrite":'), node, F.lit(',"skill_rewrites":'), listed(F.col("rw").isNotNull(), rewrite), F.lit(',"add_edges":'), listed(F.col("ad").isNotNull(), edge),
        F.lit(',"merges":'), listed(F.col("mg").isNotNull() | sided, merge), F.lit(',"splits":'), F.when(can, F.concat(F.lit("["), split, F.lit("]"))).otherwise("[]"),
        F.when(c == 1, ',"more":[]').otherwise(""), F.lit("}"),
    )
    return rows.select("parent", "n", F.when(c == 21, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body).alias("reply"))


def _judged(v):
    ev = _round(v)
    replies = cut_lineage(_replies(ev))
    return replies, proposals.judge(replies, ev["relations"], ev["rows"], ev["misses"], ev["involved"], ev["splits"], v.node)


@query("proposal_contract", f"WITH {MATERIAL_SQL} SELECT parent, rule FROM jd", ALL_VIEWS)
def proposal_contract(v):
    """Every parent's reply with one planted fault, judged against its evidence."""
    return _judged(v)[1]["verdicts"].select("parent", "rule")


@query(
    "evidence_rows",
    f"""WITH {SUMMARY_SQL} SELECT rr.parent, rr.a, rr.b, rr.relation, support, rank, rr.query_id, rr.source, rr.reason, rr.distinction FROM rr JOIN top USING (parent, a, b, relation)""",
    ALL_VIEWS,
)
def evidence_rows(v):
    """The whole evidence of every retained relation, one row per request."""
    return _round(v)["rows"].select(*evidence.KEY, "support", "rank", "query_id", "source", "reason", "distinction")


_APPLIED = f"""{MATERIAL_SQL}, acc AS MATERIALIZED (SELECT * FROM jd WHERE rule IS NULL),
dead AS (SELECT skill FROM skill WHERE merged_into IS NOT NULL),
mw AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n) AS i, n, least(ma, mb) AS keep, greatest(ma, mb) AS remove FROM acc
  WHERE ma IS NOT NULL AND ma NOT IN (SELECT skill FROM dead) AND mb NOT IN (SELECT skill FROM dead)),
mf AS MATERIALIZED (SELECT i, ok FROM (WITH RECURSIVE f(i, gone, ok) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false
    UNION ALL SELECT mw.i, CASE WHEN list_contains(gone, keep) OR list_contains(gone, remove) THEN gone ELSE list_append(gone, remove) END,
      NOT (list_contains(gone, keep) OR list_contains(gone, remove)) FROM f JOIN mw ON mw.i = f.i + 1) SELECT * FROM f) WHERE i > 0),
am AS MATERIALIZED (SELECT mw.* FROM mw JOIN mf ON mf.i = mw.i WHERE ok),
ch AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE g(skill, live, n) AS (SELECT remove, keep, n FROM am UNION ALL SELECT g.skill, am.keep, am.n FROM g JOIN am ON am.remove = g.live) SELECT * FROM g)),
alive AS (SELECT acc.*, a.n AS rw_gone, d.n AS ad_gone FROM acc LEFT JOIN am a ON a.remove = rw LEFT JOIN am d ON d.remove = ad),
ra AS MATERIALIZED (SELECT rw AS skill, min(n) AS n FROM alive WHERE rw IS NOT NULL AND (rw_gone IS NULL OR rw_gone >= n) GROUP BY rw),
da AS MATERIALIZED (SELECT parent AS node, ad AS skill, n FROM alive t WHERE ad IS NOT NULL AND (ad_gone IS NULL OR ad_gone >= n) AND NOT (c = 7 AND alo IS NOT NULL AND NOT d_own)
  AND NOT EXISTS (SELECT 1 FROM member e WHERE e.node = parent AND e.skill = ad)
  AND NOT EXISTS (SELECT 1 FROM member e JOIN ch ON ch.skill = e.skill WHERE e.node = parent AND ch.live = ad AND ch.n < t.n)),
mv AS MATERIALIZED (SELECT parent, n, s FROM (SELECT parent, n, unnest(cands[1:CASE WHEN c = 17 THEN 4 ELSE k END]) AS s FROM acc WHERE sp AND NOT (c = 18 AND split_required)) t
  WHERE NOT EXISTS (SELECT 1 FROM am WHERE am.remove = t.s AND am.n <= t.n))"""


@query(
    "flow_revise",
    f"""WITH {_APPLIED} SELECT operation, n FROM (SELECT 'rewrite_skill' AS operation, count(*) AS n FROM ra UNION ALL SELECT 'add_edge', count(*) FROM da
  UNION ALL SELECT 'merge', count(*) FROM am UNION ALL SELECT 'split_rewire', count(*) FROM mv) WHERE n > 0""",
    (*ALL_VIEWS, "skill"),
)
def flow_revise(v):
    """Diagnoses to evidence, proposals, verdicts, verified merges and the next version, read back with its patch log."""
    from routeloom.plans.q_io import _scratch
    from routeloom.sources import sinks

    root, after = _scratch(v), _revised(v)
    sinks.checkpoint_sink(v.spark, root, {k: after[k] for k in ("skills", "nodes", "edges", "members")}, after["patch"])
    return proposals.edits_by_operation(sinks.read_checkpoint(v.spark, root, ["patch"])["patch"])


def _revised(v):
    _, judged = _judged(v)
    merges = judged["edits"].where("section = 4")
    verified = merges.select(F.least("keep", "remove").alias("x"), F.greatest("keep", "remove").alias("y"), F.least("keep", "remove").alias("keep"))
    nodes = ordered.positions(v.node, [], ["name"], "ord")
    return proposals.apply_in_order(v.skill.select("skill", "description", "merged_into"), nodes, v.edge, v.member, judged, verified)


@query(
    "revised_memberships",
    f"""WITH {_APPLIED}, st AS (SELECT node, skill, pos FROM member UNION ALL SELECT node, skill, NULL FROM da),
sl AS (SELECT parent AS node, max(n) AS t FROM mv GROUP BY parent),
nw AS (SELECT st.node, st.skill, coalesce((SELECT arg_max(live, ch.n) FROM ch WHERE ch.skill = st.skill AND ch.n <= sl.t), st.skill) AS now FROM st JOIN sl ON sl.node = st.node),
al3 AS (SELECT node, skill FROM st WHERE node NOT IN (SELECT node FROM sl) UNION ALL SELECT node, skill FROM nw WHERE (node, now) NOT IN (SELECT (parent, s) FROM mv)
  UNION ALL SELECT 'child of ' || parent, s FROM mv),
fin AS (SELECT DISTINCT node, coalesce((SELECT arg_max(live, ch.n) FROM ch WHERE ch.skill = al3.skill), al3.skill) AS skill FROM al3)
SELECT node, count(*) AS skills, min(skill) AS first_skill FROM fin GROUP BY node""",
    (*ALL_VIEWS, "skill"),
)
def revised_memberships(v):
    """Members of every node after the revision; the children of a split node are told together."""
    after = _revised(v)
    origin = after["patch"].where("operation = 'split_rewire'").select(F.col("to_node").alias("node"), F.concat(F.lit("child of "), "node").alias("origin")).distinct()
    named = after["members"].join(origin, "node", "left").select(F.coalesce("origin", "node").alias("node"), "skill").distinct()
    return named.groupBy("node").agg(F.count(F.lit(1)).alias("skills"), F.min("skill").alias("first_skill"))
