"""Resume, join and publication queries."""

from pyspark.sql import functions as F

from routeloom.functions import text as tx, vector as vx
from routeloom.operators import ordered, ranking, resume, vectors
from routeloom.plans.q_ranking import _RANKED, source_ranks
from routeloom.plans.registry import query

WD = ("wanted", "done")


@query(
    "resume_pending",
    "SELECT doc_id, source FROM wanted WHERE doc_id NOT IN (SELECT doc_id FROM done WHERE version = 'v1')",
    WD,
)
def resume_pending(v):
    return resume.pending(v.wanted, resume.valid_cache(v.done, "v1"), "doc_id").select("doc_id", "source")


@query(
    "assigned_only",
    """SELECT source, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS kept,
  count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) AS dropped FROM wanted GROUP BY source""",
    WD,
)
def assigned_only(v):
    docs = v.wanted.select("doc_id", "source")
    kept = docs.join(v.table("labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    total = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    got = kept.groupBy("source").agg(F.count(F.lit(1)).alias("k"))
    return total.join(got, "source", "left").select(
        "source", F.coalesce("k", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("k", F.lit(0))).alias("dropped")
    )


@query(
    "missing_reference",
    "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey >= 50)",
)
def missing_reference(v):
    known = v.table("customer").where("c_custkey >= 50").select(F.col("c_custkey").alias("user_id"))
    return v.table("events").select("user_id").distinct().join(known, "user_id", "left_anti")


@query(
    "exclusion_split",
    """SELECT doc_id, CASE WHEN doc_id IN (SELECT item_id * 50 FROM benchmark) THEN 'excluded' ELSE 'selected' END AS status
FROM documents UNION ALL SELECT item_id * 50, 'unknown' FROM benchmark WHERE item_id * 50 NOT IN (SELECT doc_id FROM documents)""",
)
def exclusion_split(v):
    ids = v.table("benchmark").select((F.col("item_id") * 50).alias("doc_id"))
    return resume.exclusion_split(v.table("documents").select("doc_id"), ids, "doc_id")


@query(
    "observed_rank",
    f"""WITH r AS ({_RANKED}), s AS (SELECT l_orderkey, 'part_' || max(l_partkey) AS skill FROM line GROUP BY 1)
SELECT s.l_orderkey AS query_id, s.skill, rank AS source_rank FROM s LEFT JOIN r ON r.l_orderkey = s.l_orderkey AND r.skill = s.skill""",
    ("line",),
)
def observed_rank(v):
    return source_ranks(v)


@query(
    "coretrieved_batch",
    f"""WITH r AS ({_RANKED}), s AS (SELECT l_orderkey, 'part_' || max(l_partkey) AS skill FROM line GROUP BY 1),
b AS (SELECT l_orderkey, skill FROM r UNION SELECT l_orderkey, skill FROM s),
n AS (SELECT skill, count(DISTINCT node) AS nodes FROM member GROUP BY skill)
SELECT b.l_orderkey AS query_id, b.skill, rank, coalesce(nodes, 0) AS nodes FROM b
LEFT JOIN r ON r.l_orderkey = b.l_orderkey AND r.skill = b.skill LEFT JOIN n ON n.skill = b.skill""",
    ("line", "member"),
)
def coretrieved_batch(v):
    """Top ten per request plus the source where it is missing, with ranks and memberships."""
    top = ranking.rank_topk(v.line, "l_orderkey", ["ln", "l_partkey"]).select(
        F.col("l_orderkey").alias("query_id"), "skill", "rank"
    )
    missing = source_ranks(v).where("source_rank IS NULL").select("query_id", "skill", F.lit(None).cast("int").alias("rank"))
    nodes = v.member.groupBy("skill").agg(F.countDistinct("node").alias("nodes"))
    return top.unionByName(missing).join(nodes, "skill", "left").select(
        "query_id", "skill", "rank", F.coalesce("nodes", F.lit(0)).alias("nodes")
    )


@query(
    "category_index_asof",
    """WITH f AS (SELECT *, min(step) OVER (PARTITION BY category) AS born FROM decision),
d AS (SELECT step, category, born, max(CASE WHEN op = 'revise' OR step = born THEN step END) OVER (PARTITION BY category ORDER BY step
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM f)
SELECT d.step, d.category, e.description AS visible, (SELECT count(DISTINCT category) FROM decision z WHERE z.step < d.step) AS index_size
FROM d LEFT JOIN decision e ON e.step = d.seen""",
    ("decision",),
)
def category_index_asof(v):
    """Per step: the description of its category before the step and the size of the index then."""
    log = v.decision
    born = log.groupBy("category").agg(F.min("step").alias("born"))
    marked = log.join(born, "category")
    told = F.when((F.col("op") == "revise") | (F.col("step") == F.col("born")), F.struct("step", "description"))
    seen = ordered.running(
        marked.select("step", "category", told.alias("told"), (F.col("step") == F.col("born")).cast("long").alias("new")),
        ["category"], ["step"], {"seen": ("max", F.col("told"), False)},
    )
    sized = ordered.running(seen, [], ["step"], {"index_size": ("sum", F.col("new"), False)})
    return sized.select("step", "category", F.col("seen.description").alias("visible"), "index_size")


@query(
    "replay_decisions",
    """WITH f AS (SELECT *, min(step) OVER (PARTITION BY category) AS born FROM decision)
SELECT category, min(step) AS first_step, arg_max(description, step) FILTER (WHERE op = 'revise' OR step = born) AS description,
  count(DISTINCT skill) AS members, arg_min(skill, step) AS first_member FROM f GROUP BY category""",
    ("decision",),
)
def replay_decisions(v):
    log = v.decision
    first = F.min(F.struct("step", "skill", "description"))
    last = F.max(F.when(F.col("op") == "revise", F.struct("step", "description")))
    got = log.groupBy("category").agg(first.alias("f"), last.alias("l"), F.countDistinct("skill").alias("members"))
    return got.select(
        "category", F.col("f.step").alias("first_step"),
        F.coalesce("l.description", "f.description").alias("description"), "members", F.col("f.skill").alias("first_member"),
    )


@query("input_drift", "SELECT w.doc_id FROM wanted w JOIN done d ON d.doc_id = w.doc_id WHERE digest <> stored_digest", WD)
def input_drift(v):
    return resume.input_drift(v.wanted, v.done, "doc_id", "digest", "stored_digest").select("doc_id")


@query(
    "result_precedence",
    """SELECT w.doc_id, CASE WHEN has_review THEN 'new ' || digest ELSE stored_digest END AS result,
  CASE WHEN has_review THEN source ELSE version END AS goal, CASE WHEN has_review THEN 'fresh' ELSE 'cached' END AS origin
FROM wanted w JOIN done d ON d.doc_id = w.doc_id""",
    WD,
)
def result_precedence(v):
    wanted = v.wanted.withColumnRenamed("source", "goal")
    fresh = v.done.where("has_review").join(v.wanted, "doc_id").select("doc_id", F.concat(F.lit("new "), "digest").alias("result"))
    cached = v.done.select("doc_id", F.col("stored_digest").alias("result"), F.col("version").alias("goal"))
    return resume.result_precedence(wanted, fresh, cached, "doc_id")


@query(
    "identity_leak",
    """WITH tok AS (SELECT DISTINCT source, lower(string_split(url_word, ' ')[1]) AS token FROM
  (SELECT source, arg_min(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), doc_id) AS url_word FROM documents GROUP BY source, lang))
SELECT doc_id, count(*) AS leaks FROM documents d JOIN tok ON tok.source = d.source WHERE token <> '' AND contains(lower(d.text), token) GROUP BY doc_id""",
)
def identity_leak(v):
    """Documents that contain a name their source must not show."""
    docs = v.table("documents")
    words = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    named = docs.groupBy("source", "lang").agg(F.min_by(words, "doc_id").alias("w"))
    tokens = named.select("source", F.substring_index("w", " ", 1).alias("token")).where("token <> ''").distinct()
    return resume.identity_leaks(docs.select("doc_id", "source", "text"), tokens, "source", "doc_id", "text")


@query(
    "mean_similarity",
    """WITH cm AS (SELECT label, comp, list(x ORDER BY i) AS m FROM (SELECT label, vec_id % 3 AS comp, i, avg(v[i]) AS x FROM
  (SELECT vec_id, label, v, unnest(range(1, len(v) + 1)) AS i FROM vector) GROUP BY ALL) GROUP BY label, comp)
SELECT vec_id, cm.comp AS component, round(list_dot_product(v, m), 6) AS similarity FROM vector JOIN cm ON cm.label = vector.label""",
    ("vector",),
)
def mean_similarity(v):
    """Each vector against every component mean of its own group."""
    comp = v.vector.withColumn("part", F.struct("label", (F.col("vec_id") % 3).alias("comp")))
    means = vectors.group_means(comp, "part", "v").select("part.label", "part.comp", "mean")
    return v.vector.join(means, "label").select(
        "vec_id", F.col("comp").alias("component"), F.round(vx.dot_product(F.col("v"), F.col("mean")), 6).alias("similarity")
    )


@query(
    "resume_state",
    """SELECT w.doc_id, CASE WHEN digest = stored_digest AND has_review THEN 'fully_cached' WHEN digest = stored_digest
  THEN 'consistency_only' ELSE 'new' END AS state FROM wanted w LEFT JOIN done d ON d.doc_id = w.doc_id""",
    WD,
)
def resume_state(v):
    return resume.resume_state(v.wanted, v.done, "doc_id", "digest", "stored_digest")


@query(
    "resume_state_counts",
    """SELECT state, count(*) AS n FROM (SELECT CASE WHEN digest = stored_digest AND has_review THEN 'fully_cached'
  WHEN digest = stored_digest THEN 'consistency_only' ELSE 'new' END AS state FROM wanted w LEFT JOIN done d ON d.doc_id = w.doc_id) GROUP BY state""",
    WD,
)
def resume_state_counts(v):
    states = resume.resume_state(v.wanted, v.done, "doc_id", "digest", "stored_digest")
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cache_validity",
    """SELECT w.doc_id, version = 'v1' AND has_review AS valid FROM wanted w JOIN done d ON d.doc_id = w.doc_id""",
    WD,
)
def cache_validity(v):
    valid = resume.valid_cache(v.done, "v1", F.col("has_review")).select("doc_id", F.lit(True).alias("ok"))
    return v.done.select("doc_id").join(valid, "doc_id", "left").select("doc_id", F.coalesce("ok", F.lit(False)).alias("valid"))


@query(
    "unsafe_resume",
    """SELECT w.doc_id, stage, CASE WHEN stage = 'edit' THEN 'regenerate' ELSE 'stop' END AS action FROM wanted w
JOIN done d ON d.doc_id = w.doc_id, (VALUES ('retrieval'), ('edit')) s(stage) WHERE digest <> stored_digest""",
    WD,
)
def unsafe_resume(v):
    stages = [
        resume.unsafe_resume(v.wanted, v.done, "doc_id", "digest", "stored_digest", s).withColumn("stage", F.lit(s))
        for s in ("retrieval", "edit")
    ]
    return stages[0].unionByName(stages[1])


@query(
    "key_conflicts",
    """SELECT digest, sum(n)::BIGINT - count(*) AS collapsed, count(*) > 1 AS conflict FROM
  (SELECT digest, source, lang, count(*) AS n FROM wanted GROUP BY ALL) GROUP BY digest""",
    WD,
)
def key_conflicts(v):
    return resume.key_conflicts(v.wanted, "digest", ["source", "lang"])


@query(
    "consistency_contract",
    """SELECT doc_id, CASE WHEN ok AND n_issues > 0 THEN 'issues' WHEN ok AND final <> stored_digest THEN 'verbatim'
  WHEN NOT ok AND n_issues = 0 THEN 'no_issue' END AS rule FROM (SELECT d.doc_id, stored_digest, toxic = 0 AS ok, quality AS n_issues,
  digest AS final FROM done d JOIN labels l ON l.doc_id = d.doc_id JOIN wanted w ON w.doc_id = d.doc_id)""",
    WD,
)
def consistency_contract(v):
    rows = v.done.join(v.table("labels"), "doc_id").join(v.wanted, "doc_id").select(
        "doc_id", (F.col("toxic") == 0).alias("consistent"), F.col("quality").alias("n_issues"),
        F.col("stored_digest").alias("expanded"), F.col("digest").alias("final_query"),
    )
    return resume.consistency_contract(rows).select("doc_id", "rule")


@query(
    "publish_split_sink",
    """SELECT doc_id AS data_id, row_number() OVER (ORDER BY doc_id) AS ord, md5(regexp_replace(text, '\\s+$', '') ||
  CASE WHEN toxic = 0 THEN chr(10) || chr(10) || source ELSE '' END) AS query, quality AS audit_quality
FROM documents JOIN labels USING (doc_id)""",
)
def publish_split(v):
    """Published rows in source order, expanded and audit projections joined for comparison."""
    done = v.table("documents").join(v.table("labels"), "doc_id")
    extra = F.when(F.col("toxic") == 0, F.col("source")).otherwise("")
    # only ids are numbered; texts meet their number after it
    numbered = done.join(ordered.positions(done.select("doc_id"), [], ["doc_id"], "ord"), "doc_id")
    results = numbered.select(
        "ord", F.col("doc_id").alias("data_id"), F.col("text").alias("original_query"), extra.alias("expanded_query"),
        tx.append_requirements(F.col("text"), extra).alias("query"), F.col("quality").alias("audit_quality"),
    )
    expanded, audit = resume.publish_rows(results)
    return expanded.select("ord", "data_id", F.md5("query").alias("query")).join(audit.select("data_id", "audit_quality"), "data_id")
