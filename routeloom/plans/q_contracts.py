"""Contract queries.  Replies are built from whole tables with one planted defect per record class."""

from pyspark.sql import functions as F

from routeloom.functions import text as tx
from routeloom.operators import contracts as ct
from routeloom.plans.registry import query
from routeloom.session import cut_lineage


def _ids(v):
    """Requests with the names of their batch and the reply class."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "skill", "applicable", "score")))
    return v.batch.groupBy("l_orderkey").agg(packed.alias("items")).select(
        F.col("l_orderkey").alias("query_id"),
        F.transform("items", lambda i: i["skill"]).alias("supplied"),
        "items",
        (F.col("l_orderkey") % 10).alias("cls"),
    )


def _json(*pairs):
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), c) for k, c in pairs]), F.lit("}"))


def _q(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


def _review_replies(v):
    """0 extra key, 1 missing key, 2 text score, 3 boolean score, 4 repeat, 5 unknown name,
    6 blank reason, 7 cut off (in the first item, or behind items that are read instead), 8 fenced, 9 valid."""
    cls = F.col("cls")

    def item(i, at):
        head = at == 0
        name = F.when(head & (cls == 5), "nobody").otherwise(i["skill"])
        score = F.when(head & (cls == 2), _q(i["score"].cast("string"))).when(head & (cls == 3), "true").otherwise(i["score"].cast("string"))
        reason = F.when(head & (cls == 6), "  ").otherwise("fits")
        full = _json(("name", _q(name)), ("applicable", i["applicable"].cast("string")), ("score", score), ("reason", _q(reason)))
        short = _json(("name", _q(name)), ("applicable", i["applicable"].cast("string")), ("score", score))
        return F.when(head & (cls == 1), short).otherwise(full)

    listed = F.transform("items", item)
    listed = F.when(cls == 4, F.concat(listed, F.slice(listed, 1, 1))).otherwise(listed)
    body = _json(("decisions", F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))))
    body = F.when(cls == 0, F.concat(F.lit('{"extra":1,'), F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
    body = F.when(cls == 7, F.substring(body, F.lit(1), F.when(F.col("query_id") % 20 == 7, F.length(body) - 2).otherwise(20))).when(cls == 8, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return _ids(v).select("query_id", "supplied", body.alias("reply"))


@query(
    "review_reply_contract",
    """SELECT DISTINCT l_orderkey AS query_id, CASE WHEN l_orderkey % 20 = 7 THEN 'keys'
  ELSE ['keys','item_keys','score','score','name','name','reason','json',NULL,NULL][l_orderkey % 10 + 1] END AS rule
FROM batch""",
    ("batch",),
)
def review_reply_contract(v):
    replies = _review_replies(v).withColumn("body", tx.first_json_object(F.col("reply")))
    return ct.check_review_reply(replies, "body", "supplied").select("query_id", "rule")


@query(
    "route_reply_contract",
    """SELECT l_orderkey AS query_id, rule, CASE WHEN rule IS NULL THEN string_agg(pos || ':' || skill, ',' ORDER BY pos) END AS ranking FROM (
  SELECT *, ['keys','item_keys','confidence','list',NULL,'name','reason','json',NULL,NULL][l_orderkey % 10 + 1] AS rule FROM batch)
GROUP BY l_orderkey, rule""",
    ("batch",),
)
def route_reply_contract(v):
    cls = F.col("cls")

    def item(i, at):
        head = at == 0
        name = _q(F.when(head & (cls == 5), "nobody").otherwise(i["skill"]))
        conf = _q(F.when(head & (cls == 2), "certain").otherwise("high"))
        reason = _q(F.when(head & (cls == 6), "").otherwise("near"))
        full = _json(("name", name), ("reason", reason), ("confidence", conf))
        return F.when(head & (cls == 1), _json(("name", name), ("confidence", conf))).otherwise(full)

    listed = F.concat(F.lit("["), F.array_join(F.transform("items", item), ","), F.lit("]"))
    body = _json(("ranking", F.when(cls == 3, _q(F.lit("none"))).otherwise(listed)))
    body = F.when(cls == 0, _json(("ranking", listed), ("note", _q(F.lit("x"))))).when(cls == 7, F.lit('{"ranking":[')).otherwise(body)
    rows = _ids(v).select("query_id", "supplied", body.alias("body"))
    judged = ct.check_route_reply(rows, "body", "supplied")
    shown = F.transform("ranking", lambda r: F.concat_ws(":", r["rank"].cast("string"), r["name"]))
    return judged.select("query_id", "rule", F.array_join(shown, ",").alias("ranking"))


@query(
    "closed_keys",
    "SELECT doc_id, doc_id % 3 = 0 AS exact FROM documents",
)
def closed_keys(v):
    kind = F.col("doc_id") % 3
    body = F.when(kind == 0, F.to_json(F.struct("lang", "text"))).when(kind == 1, F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct("lang", "text", "source")))
    return v.table("documents").select("doc_id", ct.closed_keys(body, ["text", "lang"]).alias("exact"))


@query(
    "nonblank_fields",
    """SELECT doc_id, CASE WHEN quality IS NULL THEN 'quality' WHEN doc_id % 5 = 0 THEN 'source' WHEN trim(text) = '' THEN 'text' END AS field
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def nonblank_fields(v):
    rows = v.table("documents").join(v.table("labels").select("doc_id", "quality"), "doc_id", "left")
    source = F.when(F.col("doc_id") % 5 == 0, " \n").otherwise(F.col("source"))
    field = ct.nonblank_fields({"quality": F.col("quality").cast("string"), "source": source, "text": F.col("text")})
    return rows.select("doc_id", field.alias("field"))


@query(
    "segments_contract",
    """SELECT conv_id, n, CASE WHEN n <> 3 THEN 'count' WHEN swapped THEN 'order' WHEN blank THEN 'text' END AS rule FROM (SELECT conv_id,
  count(*) AS n, min(role) FILTER (WHERE turn = 0) = 'system' AS swapped, count(*) FILTER (WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '') > 0 AS blank
  FROM conversations GROUP BY conv_id)""",
)
def segments_contract(v):
    """Every turn of a talk as a segment; where a system turn opens the talk its level comes last."""
    level = (
        F.when((F.col("turn") == 0) & (F.col("role") == "system"), "interaction").when(F.col("turn") == 0, "goal")
        .when(F.col("turn") == 1, "experience").otherwise("interaction")
    )
    rows = v.table("conversations").withColumn("level", level)
    return ct.segment_sets(rows, "conv_id", "turn", "level", "text").select("conv_id", "n", "rule")


_TERMS = ", ".join(
    f"nullif(regexp_extract(text, '{pattern}', 0), '')" for pattern in tx.APPLICATION_TERMS + tx.TECHNOLOGY_PATTERNS
)


@query("forbidden_terms", f"SELECT doc_id, coalesce({_TERMS}) AS term FROM term_doc", ("term_doc",))
def forbidden_terms(v):
    return v.term_doc.select("doc_id", tx.first_forbidden(F.col("text")).alias("term"))


@query(
    "distillation_contract",
    """SELECT query_id, CASE c WHEN 0 THEN 'duplicate_category' WHEN 1 THEN 'category_reference' WHEN 2 THEN 'duplicate_skill' WHEN 3 THEN 'unused_category'
  WHEN 4 THEN 'marker_missing' WHEN 5 THEN 'marker_extra' WHEN 6 THEN 'summary' END AS rule FROM (SELECT DISTINCT l_orderkey AS query_id, l_orderkey % 10 AS c FROM batch)""",
    ("batch",),
)
def distillation_contract(v):
    packed = F.array_sort(F.collect_list(F.struct("pos", "skill", "typ")))
    cls = F.col("cls")
    rows = v.batch_part.groupBy("l_orderkey").agg(packed.alias("items")).select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_orderkey") % 10).alias("cls"), "items",
        F.array_distinct(F.transform("items", lambda i: i["typ"])).alias("cats"),
    )
    skill = lambda i: F.struct(i["skill"].alias("name"), F.array(F.when(cls == 1, "type_none").otherwise(i["typ"])).alias("category_names"))
    skills = F.transform("items", skill)
    none = F.array_remove(F.array(F.lit("x")), "x")
    cats = (
        F.when(cls == 0, F.concat("cats", F.slice("cats", 1, 1)))
        .when(cls == 3, F.concat("cats", F.array(F.lit("type_spare"))))
        .when(cls == 4, none)
        .otherwise(F.col("cats"))
    )
    skills = F.when(cls == 2, F.concat(skills, F.slice(skills, 1, 1))).when(cls == 4, F.slice(skills, 1, 0)).otherwise(skills)
    summary = F.when(cls == 5, ct.EXCLUSION_MARKER).when(cls == 6, " ").otherwise("a case")
    built = rows.select("query_id", summary.alias("summary"), cats.alias("cats"), skills.alias("skills"))
    judged = ct.check(built, ct.distillation_rules(F.col("summary"), F.col("cats"), F.col("skills")))
    return judged.select("query_id", "rule")


@query(
    "nested_record_contract",
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'keys' WHEN 1 THEN 'interaction_model' WHEN 2 THEN 'interaction_keys' WHEN 3 THEN 'interaction_text'
  WHEN 4 THEN 'name' WHEN 5 THEN 'content_and_composition' WHEN 6 THEN 'adaptable_details' END AS rule FROM part""",
)
def nested_record_contract(v):
    cls = F.col("p_partkey") % 8
    step = lambda *names: _json(*[(n, _q(F.when((cls == 3) & F.lit(n == "input"), " ").otherwise(F.col("p_name")))) for n in names])
    model = F.when(cls == 1, "").when(cls == 2, step(*ct.INTERACTION_FIELDS[:4])).otherwise(step(*ct.INTERACTION_FIELDS))
    many = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    fields = {f: _q(F.col("p_name")) for f in ct.SKILL_FIELDS}
    fields["name"] = _q(F.when(cls == 4, "Not Snake").otherwise(F.col("skill")))
    for f in ct.LIST_MINIMUM:
        fields[f] = many(_q(F.col("p_name")))
    fields["content_and_composition"] = many(F.when(cls == 5, "").otherwise(_q(F.col("p_name"))))
    fields["adaptable_details"] = many(F.when(cls == 6, '" "').otherwise(""))
    fields["interaction_model"] = many(model)
    whole = _json(*fields.items())
    fewer = _json(*[(k, c) for k, c in fields.items() if k != "portability_boundary"])
    rows = v.part_dag.select("p_partkey", F.when(cls == 0, fewer).otherwise(whole).alias("body"))
    return ct.check(rows, ct.skill_record_rules(F.col("body"))).select("p_partkey", "rule")


@query(
    "category_doc_contract",
    """SELECT name, CASE WHEN NOT regexp_full_match(name, '[a-z0-9]+(_[a-z0-9]+)*') THEN 'snake_case' WHEN NOT regexp_matches(description, '(?i)\\bfits\\b')
  THEN 'fits' END AS rule FROM (SELECT name, description FROM node UNION ALL SELECT p_type || '_' || p_partkey, 'Fits ' || p_name FROM part_dag
  UNION ALL SELECT skill, p_name FROM part_dag)""",
    ("node",),
)
def category_doc_contract(v):
    upper = v.part_dag.select(F.concat_ws("_", "p_type", F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("Fits "), "p_name").alias("description"))
    plain = v.part_dag.select(F.col("skill").alias("name"), F.col("p_name").alias("description"))
    rows = v.node.select("name", "description").unionByName(upper).unionByName(plain)
    return ct.check(rows, ct.category_rules(F.col("name"), F.col("description"))).select("name", "rule")


@query(
    "query_set_contract",
    """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations),
n AS (SELECT *, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS norm, len(string_split(t, ' ')) AS w FROM c),
j AS (SELECT *, CASE WHEN w < 3 OR w > 50 THEN 'word_count' WHEN regexp_matches(t, '[㐀-鿿]') THEN 'cjk'
  WHEN norm = '' OR min(turn) OVER (PARTITION BY conv_id, norm) < turn THEN 'duplicate' END AS rule FROM n)
SELECT conv_id, count(*) AS n, CASE WHEN count(*) <> 6 THEN 'size' ELSE arg_min(rule, turn) FILTER (WHERE rule IS NOT NULL) END AS rule FROM j GROUP BY conv_id""",
)
def query_set_contract(v):
    return ct.query_set_audit(v.table("conversations"), "conv_id", "turn", "text", 6).select("conv_id", "n", "rule")


_DIAG = """WITH r AS (SELECT l_orderkey, skill, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, ln, l_partkey) AS rank FROM line WHERE applicable),
h AS (SELECT d.query_id, d.source, d.operation, d.target, d.replacement, rank AS source_rank, CASE d.operation WHEN 'rewrite_skill' THEN 'candidate_rank'
  WHEN 'add_edge' THEN 'root_route' ELSE CASE WHEN rank <= 10 THEN 'none' ELSE 'candidate_rank' END END AS stage, st = 'O' AS covered FROM diagnosis d
  LEFT JOIN r ON r.l_orderkey = d.query_id AND r.skill = d.source AND rank <= 10 JOIN batch b ON b.l_orderkey = d.query_id AND b.pos = 1),
w AS (SELECT *, CASE WHEN NOT covered THEN 'root_route' WHEN source_rank IS NULL THEN 'candidate_rank' ELSE 'none' END AS lost FROM h)
SELECT query_id, CASE WHEN lost = 'none' AND operation <> 'none' THEN 'hit_repaired' WHEN lost = 'none' AND stage <> 'none' THEN 'hit_stage'
  WHEN lost = 'root_route' AND NOT (stage = 'root_route' AND operation IN ('none', 'rewrite_node', 'add_edge')) THEN 'root_boundary'
  WHEN lost = 'candidate_rank' AND NOT (stage = 'candidate_rank' AND operation IN ('none', 'rewrite_skill')) THEN 'skill_boundary'
  WHEN operation = 'add_edge' AND target NOT IN (SELECT name FROM node) THEN 'node_target' END AS rule FROM w"""


@query("diagnosis_contract", _DIAG, ("diagnosis", "batch", "node"))
def diagnosis_contract(v):
    """Headers against the observed rank; sources shipped open count as candidates."""
    from routeloom.operators import ranking

    ranked = ranking.rank_topk(v.line, "l_orderkey", ["ln", "l_partkey"]).select(F.col("l_orderkey").alias("query_id"), F.col("skill").alias("source"), F.col("rank").alias("source_rank"))
    first = v.batch.where("pos = 1").select(F.col("l_orderkey").alias("query_id"), (F.col("st") == "O").alias("covered"))
    known = v.node.select(F.col("name").alias("target"), F.lit(True).alias("target_known"))
    rows = v.diagnosis.join(ranked, ["query_id", "source"], "left").join(first, "query_id").join(known, "target", "left")
    stage = (
        F.when(F.col("operation") == "rewrite_skill", "candidate_rank").when(F.col("operation") == "add_edge", "root_route")
        .when(F.col("source_rank") <= 10, "none").otherwise("candidate_rank")
    )
    return ct.check(rows.withColumn("stage", stage), ct.diagnosis_rules()).select("query_id", "rule")


@query(
    "relation_contract",
    """WITH x AS (SELECT query_id, a, b, CASE WHEN query_id % 9 = 0 THEN 'close' ELSE relation END AS relation, CASE WHEN query_id % 9 = 1 THEN 'brand_none' ELSE split_parent END AS split_parent,
  distinction FROM relation)
SELECT query_id, a, b, relation, CASE WHEN relation = 'close' THEN 'relation' WHEN relation = 'same' AND split_parent <> '' THEN 'same_fields'
  WHEN relation <> 'same' AND split_parent NOT IN (SELECT name FROM node) THEN 'alternative_fields' END AS rule FROM x""",
    ("relation", "node"),
)
def relation_contract(v):
    """Relation items, each sent twice with the pair turned round the second time."""
    cls = F.col("query_id") % 9
    base = v.relation.select(
        "query_id", "a", "b", F.when(cls == 0, "close").otherwise(F.col("relation")).alias("relation"),
        F.when(cls == 1, "brand_none").otherwise(F.col("split_parent")).alias("split_parent"), "distinction", F.lit(1).alias("pos"),
    )
    turned = base.withColumns({"a": F.col("b"), "b": F.col("a"), "pos": F.lit(2)})
    rows = ct.first_relations(base.unionByName(turned))
    names = v.part_dag.select("skill")
    known = v.node.select(F.col("name").alias("split_parent"), F.lit(True).alias("parent_known"))
    rows = (
        rows.join(names.select(F.col("skill").alias("a"), F.lit(True).alias("a_known")), "a", "left")
        .join(names.select(F.col("skill").alias("b"), F.lit(True).alias("b_known")), "b", "left")
        .join(known, "split_parent", "left")
    )
    return ct.check(rows, ct.relation_rules()).select("query_id", "a", "b", "relation", "rule")


@query(
    "assignment_contract",
    """SELECT mid AS parent, skill, CASE p_partkey % 8 WHEN 0 THEN 'once' WHEN 1 THEN 'children' WHEN 2 THEN 'exclusive' WHEN 6 THEN 'missing' WHEN 7 THEN 'missing' END AS rule FROM part_dag
UNION ALL SELECT typ, skill, 'supplied' FROM part_dag WHERE p_partkey % 8 = 7""",
    ("part_dag",),
)
def assignment_contract(v):
    """Parts dealt to the children of their middle node: 0 sent twice, 1 unknown child, 2 neither kept nor moved, 3 kept, 6 not answered, 7 answered for another parent."""
    cls = F.col("p_partkey") % 8
    kids = F.when(cls == 1, F.array(F.lit("leaf_none"))).when(cls.isin(2, 3), F.array().cast("array<string>")).otherwise(F.array("leaf"))
    times = F.when(cls == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    answers = v.part_dag.where(cls != 6).select(
        F.when(cls == 7, F.col("typ")).otherwise(F.col("mid")).alias("parent"), "skill", kids.alias("children"), (cls == 3).alias("keep"), F.explode(times).alias("n")
    )
    supplied = v.part_dag.select(F.col("mid").alias("parent"), "skill")
    return ct.check_assignments(answers, supplied, v.edge).select("parent", "skill", "rule")


@query(
    "merge_verdict_contract",
    """SELECT query_id, a, b, CASE WHEN p.p_name = q.p_name AND query_id % 2 = 1 THEN 'keep_in_pair' WHEN p.p_name <> q.p_name AND query_id % 2 = 0 THEN 'keep_empty' END AS rule
FROM relation r JOIN part_dag p ON p.skill = a JOIN part_dag q ON q.skill = b WHERE relation = 'same'""",
    ("relation",),
)
def merge_verdict_contract(v):
    names = v.part_dag.select("skill", "p_name")
    rows = (
        v.relation.where("relation = 'same'").join(names.toDF("a", "na"), "a").join(names.toDF("b", "nb"), "b")
        .withColumn("keep", F.when(F.col("query_id") % 2 == 0, F.col("a")).otherwise(""))
    )
    rules = ct.merge_verdict_rules(F.col("na") == F.col("nb"), F.col("keep"), F.col("a"), F.col("b"))
    return ct.check(rows, rules).select("query_id", "a", "b", "rule")


_LOG = """b AS (SELECT category, min((step - 1) // 2) AS born FROM decision GROUP BY 1),
e AS (SELECT (step - 1) // 2 AS d, d.category, op, step, description, born FROM decision d JOIN b ON b.category = d.category),
n AS (SELECT born AS d, min(category) AS fresh FROM b GROUP BY born),
r AS MATERIALIZED (SELECT e.*, row_number() OVER (PARTITION BY e.d ORDER BY step) - 1 AS ix, e.d % 12 AS c FROM e LEFT JOIN n ON n.d = e.d WHERE fresh IS NULL OR category <> fresh),
j AS (SELECT *, CASE WHEN ix = 0 AND c = 3 THEN 'route_keys' WHEN ix = 0 AND c = 4 THEN 'operation' WHEN known IS NULL OR known >= d THEN 'known' WHEN first < ix THEN 'once'
    WHEN ix = 0 AND c = 5 AND op = 'select' THEN 'select_empty' WHEN ix = 0 AND c = 7 AND op = 'revise' THEN 'revised' WHEN ix = 0 AND c = 6 AND op = 'revise' THEN 'rename' END AS rule
  FROM (SELECT r.*, min(ix) OVER (PARTITION BY r.d, category) AS first, k.known FROM r LEFT JOIN (SELECT fresh AS cat, min(d) AS known FROM n GROUP BY fresh) k ON k.cat = r.category)),
w AS (SELECT d, arg_min(rule, ix) AS rule FROM j WHERE rule IS NOT NULL GROUP BY d), h AS (SELECT d, count(*) AS routes FROM r GROUP BY d)"""


@query(
    "decision_log_contract",
    f"""WITH {_LOG} SELECT t.d AS decision, CASE WHEN t.d % 12 = 0 THEN 'keys' WHEN t.d % 12 = 1 THEN 'rationale' WHEN t.d % 12 = 2 THEN 'routes' WHEN t.d % 12 = 10 THEN CASE WHEN fresh IS NULL THEN 'no_membership' END
  WHEN w.rule IS NOT NULL THEN w.rule WHEN t.d % 12 = 8 AND fresh IS NOT NULL THEN 'new_category' END AS rule
FROM (SELECT DISTINCT d FROM e) t LEFT JOIN n ON n.d = t.d LEFT JOIN w ON w.d = t.d LEFT JOIN h ON h.d = t.d""",
    ("decision",),
)
def decision_log_contract(v):
    """Two events a decision: the first new category is created, other events are routes.

    Faults by decision: 0 extra field, 1 blank rationale, 2 routes no list, first route with 3 an extra
    field, 4 another operation, 5 a document on select, 6 another name, 7 no Fits; 8 new category
    without Fits, 10 no routes.  A category met twice or before it exists breaks rules by itself.
    """
    log = v.decision.withColumn("d", F.floor((F.col("step") - 1) / 2))
    born = log.groupBy("category").agg(F.min("d").alias("born"))
    fresh = born.groupBy(F.col("born").alias("d")).agg(F.min("category").alias("fresh"))
    cls = F.col("d") % 12
    events = log.join(fresh, "d", "left").where(F.col("fresh").isNull() | (F.col("category") != F.col("fresh")))
    packed = F.array_sort(F.collect_list(F.struct("step", "category", "op", "description")))
    listed = events.groupBy("d").agg(packed.alias("routes"))
    all_d = log.select("d").distinct().join(fresh, "d", "left").join(listed, "d", "left")

    def category(name, text):
        return F.to_json(F.struct(name.alias("name"), text.alias("description")))

    def route(r, at):
        head = at == 0
        op = F.when(head & (cls == 4), "create").otherwise(r["op"])
        revised = F.when(r["op"] == "revise", category(F.when(head & (cls == 6), "other_name").otherwise(r["category"]), F.when(head & (cls == 7), "none").otherwise(r["description"])))
        revised = F.coalesce(F.when(head & (cls == 5) & (r["op"] == "select"), category(r["category"], r["description"])).otherwise(revised), F.lit("null"))
        fields = [("operation", _q(op)), ("category_name", _q(r["category"])), ("revised_category", revised)]
        return F.when(head & (cls == 3), _json(*fields, ("note", _q(F.lit("x"))))).otherwise(_json(*fields))

    routes = F.concat(F.lit("["), F.array_join(F.coalesce(F.transform("routes", route), F.array().cast("array<string>")), ","), F.lit("]"))
    routes = F.when(cls == 2, _q(F.lit("none"))).when(cls == 10, "[]").otherwise(routes)
    new = F.coalesce(F.when(F.col("fresh").isNotNull(), category(F.col("fresh"), F.when(cls == 8, "none").otherwise("Fits it"))), F.lit("null"))
    fields = [("routes", routes), ("new_category", new), ("rationale", _q(F.when(cls == 1, " ").otherwise("why")))]
    body = F.when(cls == 0, _json(*fields, ("more", F.lit("1")))).otherwise(_json(*fields))
    return ct.check_decisions(cut_lineage(all_d.select(F.col("d").alias("decision"), body.alias("body"))), "decision", "body").select("decision", "rule")


@query(
    "manifest_contract",
    """SELECT m, CASE m % 15 WHEN 0 THEN 'json' WHEN 1 THEN 'keys' WHEN 2 THEN 'rationale' WHEN 3 THEN 'skills' WHEN 4 THEN 'item_keys' WHEN 5 THEN 'name' WHEN 6 THEN CASE WHEN n > 1 THEN 'unique' END
  WHEN 7 THEN 'description' WHEN 8 THEN 'path' WHEN 9 THEN 'scope' WHEN 10 THEN 'contribution' WHEN 11 THEN 'evidence' WHEN 12 THEN 'evidence_keys' WHEN 13 THEN 'evidence_text' END AS rule
FROM (SELECT doc_id // 4 AS m, count(*) AS n FROM documents GROUP BY 1)""",
)
def manifest_contract(v):
    """Manifests of four documents each, one fault per manifest, on its first entry (6: one name for all)."""
    docs = v.table("documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("m"), "lang", "source")
    packed = F.array_sort(F.collect_list(F.struct("doc_id", "lang", "source")))
    rows = docs.groupBy("m").agg(packed.alias("items"))
    cls = F.col("m") % 15

    def entry(i, at):
        head = at == 0
        name = F.when(head & (cls == 5), "Bad_Name").when(cls == 6, "same-name").otherwise(F.concat(F.lit("doc-"), i["doc_id"].cast("string")))
        proof = _json(("path", _q(i["source"])), ("evidence", _q(F.when(head & (cls == 13), " ").otherwise("seen"))))
        proof = F.when(head & (cls == 12), _json(("path", _q(i["source"])))).otherwise(proof)
        fields = [
            ("name", _q(name)), ("description", _q(F.when(head & (cls == 7), " ").otherwise(i["lang"]))),
            ("relative_path", _q(F.concat(F.lit("skills/"), name, F.when(head & (cls == 8), "/skill.txt").otherwise("/SKILL.md")))),
            ("skill_contribution", _q(F.when(head & (cls == 10), "").otherwise("adds"))), ("mechanism_scope", F.when(head & (cls == 9), "[]").otherwise('["one"]')),
            ("source_evidence", F.when(head & (cls == 11), "[]").otherwise(F.concat(F.lit("["), proof, F.lit("]")))),
        ]
        return F.when(head & (cls == 4), _json(*fields[:5])).otherwise(_json(*fields))

    listed = F.when(cls == 3, "[]").otherwise(F.concat(F.lit("["), F.array_join(F.transform("items", entry), ","), F.lit("]")))
    fields = [("decomposition_rationale", _q(F.when(cls == 2, " ").otherwise("parts"))), ("skills", listed)]
    body = F.when(cls == 1, _json(*fields, ("more", F.lit("1")))).otherwise(_json(*fields))
    body = F.when(cls == 0, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    built = cut_lineage(rows.select("m", body.alias("body")))
    return ct.check(built, ct.manifest_rules(F.col("body"))).select("m", "rule")


@query(
    "document_audit",
    """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'name' WHEN 1 THEN 'front_matter' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'length' WHEN 4 THEN 'heading' WHEN 5 THEN 'sections'
  WHEN 6 THEN 'framework' WHEN 7 THEN 'identity' END AS rule FROM documents""",
)
def document_audit(v):
    """Documents rendered as skill files around the whole text, one defect per class."""
    cls, n = F.col("doc_id") % 9, F.col("doc_id").cast("string")
    name = F.concat(F.when(cls == 0, "Doc_").otherwise("doc-"), n)
    shown = F.when(cls == 2, F.concat(F.lit("other-"), n)).otherwise(name)
    head = F.concat(F.lit("---\nname: "), shown, F.lit("\ndescription: 'about "), "lang", F.lit("'\n"), F.when(cls == 1, "extra: 1\n").otherwise(""), F.lit("---\n"))
    title = F.when(cls == 4, "No title\n").otherwise("# Title\n")
    sections = [F.lit(s) for s in ct.REQUIRED_SECTIONS]
    order = F.when(cls == 5, F.array(*sections[::-1])).otherwise(F.array(*sections))
    tail = F.when(cls == 3, F.repeat(F.lit("\nrow"), 600)).when(cls == 6, "\nuses Svelte").when(cls == 7, F.concat(F.lit("\nSITE-"), n)).otherwise("")
    flat = F.regexp_replace("text", "[#\\n]", " ")
    text = F.concat(head, title, F.array_join(order, "\n"), F.lit("\n"), flat, tail)
    rows = v.table("documents").select("doc_id", text.alias("text"), name.alias("name"), F.concat(F.lit("about "), "lang").alias("description"), F.array(F.concat(F.lit("site-"), n)).alias("tokens"))
    rules = ct.document_rules(F.col("text"), F.col("name"), F.col("description"), F.col("tokens"))
    return ct.check(rows, rules).select("doc_id", "rule")


@query(
    "exact_cover",
    """SELECT l_orderkey AS query_id, CASE l_orderkey % 10 WHEN 4 THEN 'repeated' ELSE 'extra' END AS kind, CASE l_orderkey % 10 WHEN 4 THEN skill ELSE 'nobody' END AS name
FROM batch WHERE pos = 1 AND l_orderkey % 10 IN (4, 5) UNION ALL SELECT l_orderkey, 'missing', skill FROM batch WHERE pos = 1 AND l_orderkey % 10 = 5""",
    ("batch",),
)
def exact_cover(v):
    """Supplied names against answered names of the review replies that hold decisions."""
    # written before they are filtered, as a filter would read every reply twice
    replies = cut_lineage(_review_replies(v).select("query_id", "supplied", tx.first_json_object(F.col("reply")).alias("body")))
    replies = replies.where(F.get_json_object("body", "$.decisions").isNotNull())
    answered = replies.select("query_id", F.explode(ct.raw_items(F.col("body"), "decisions")).alias("i")).select("query_id", F.get_json_object("i", "$.name").alias("name"))
    supplied = replies.select("query_id", F.explode("supplied").alias("name"))
    return ct.exact_cover(supplied, answered, ["query_id", "name"])
