"""End-to-end flows composed of the operators."""

from pyspark.sql import functions as F

from routeloom.functions import text as tx
from routeloom.operators import graph, ordered, ranking, resume, vectors
from routeloom.plans.q_audit import _DISP, _dispositions
from routeloom.plans.q_contracts import _DIAG
from routeloom.plans.q_graph import FLOW_SQL, ROUTE_VIEWS, chosen_nodes, reviewed
from routeloom.plans.q_io import _scratch
from routeloom.plans.registry import ORACLES, QUERIES, query
from routeloom.session import cut_lineage
from routeloom.sources import sinks

_EXCERPT = ORACLES["evidence_excerpt"]


@query(
    "flow_source_evidence",
    f"""SELECT e.site, count(*) AS blocks, max(n.files) AS files, count(*) FILTER (WHERE truncated) AS cut FROM ({_EXCERPT}) e
JOIN (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS site, count(*) AS files FROM pages GROUP BY 1) n ON n.site = e.site GROUP BY e.site""",
)
def flow_source_evidence(v):
    """Page sources to excerpts, summarised per site."""
    files = v.page_source.select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("site"),
        F.concat(F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(".html")).alias("path"), F.lit(1).alias("pref"), "html",
    )
    blocks = ranking.evidence_excerpt(files, "site", "path", "html", F.lit(".html"), F.lit(False))
    sizes = files.groupBy("site").agg(F.count(F.lit(1)).alias("files"))
    per = blocks.groupBy("site").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("truncated").alias("cut"))
    return per.join(sizes, "site").select("site", "blocks", "files", "cut")


@query(
    "flow_candidate_index",
    """SELECT 'case_' || l_orderkey || '__s' || CASE WHEN pos < 10 THEN '0' ELSE '' END || pos AS candidate, skill, typ AS category FROM batch_part
WHERE l_orderkey % 10 > 6 AND p_size <= 40""",
    ("batch_part",),
)
def flow_candidate_index(v):
    """Distillations that hold, exploded to candidates, kept where their skill is assigned to a middle node."""
    verdict = QUERIES["distillation_contract"](v.spark, v.sf_dir).where("rule IS NULL").select(F.col("query_id").alias("l_orderkey"))
    assigned = v.member.where(F.col("node").startswith("mid_")).select("skill").distinct()
    rows = v.batch_part.join(verdict, "l_orderkey", "left_semi").join(assigned, "skill", "left_semi")
    case = F.concat(F.lit("case_"), F.col("l_orderkey").cast("string"))
    return rows.select(tx.candidate_key(case, F.col("pos")).alias("candidate"), "skill", F.col("typ").alias("category"))


@query("flow_representatives")
def flow_representatives(v):
    """Query sets to vectors, mixtures per set and one representative text per component."""
    rows = v.table("conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    vecs = vectors.embed_texts(rows, "text", "v", dims=64).where("v_state = 'ok'").withColumn("v", F.col("v").cast("array<double>"))
    vecs = cut_lineage(vecs.select("conv_id", "query_id", "v", F.md5("text").alias("digest")))
    fits = cut_lineage(vectors.group_mixture(vecs, "conv_id", "query_id", "v"))
    means = vectors.unit_means(vectors.bic_select(fits, "conv_id"), "conv_id")
    medoids = vectors.distinct_medoids(vecs, means, "conv_id", "query_id", "v")
    return medoids.join(vecs.select("query_id", "digest"), "query_id").select("conv_id", "component", "query_id", "digest")


@query(
    "flow_diagnose",
    f"""SELECT coalesce(rule, 'ok') AS rule, operation, count(*) AS n FROM ({_DIAG.replace('SELECT query_id, CASE WHEN lost', 'SELECT query_id, operation, CASE WHEN lost')}) GROUP BY ALL""",
    ("diagnosis", "batch", "node"),
)
def flow_diagnose(v):
    """Rankings to miss stages, judged diagnoses and their counts."""
    judged = QUERIES["diagnosis_contract"](v.spark, v.sf_dir)
    rows = judged.join(v.diagnosis.select("query_id", "operation"), "query_id")
    return rows.groupBy(F.coalesce("rule", F.lit("ok")).alias("rule"), "operation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flow_expand",
    f"""WITH {_DISP}, ex AS (SELECT l_orderkey, string_agg(skill, ', ' ORDER BY skill) FILTER (WHERE decision = 'accept') AS extra FROM disp GROUP BY 1)
SELECT row_number() OVER (ORDER BY o_orderkey) AS ord, o_orderkey AS data_id, 'order ' || o_orderkey || CASE WHEN extra IS NULL THEN ''
  ELSE chr(10) || chr(10) || extra END AS query FROM orders JOIN ex ON ex.l_orderkey = o_orderkey""",
    ("line",),
)
def flow_expand(v):
    """Requests to accepted skills, appended requirements and the published rows."""
    picked = _dispositions(v).where("decision = 'accept'")
    names = picked.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("skill")), ", ").alias("extra"))
    orders = v.table("orders").select("o_orderkey")
    asked = orders.join(v.line.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey")
    rows = asked.join(names, asked.o_orderkey == names.l_orderkey, "left")
    original = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    results = ordered.positions(rows, [], ["o_orderkey"], "ord").select(
        "ord", F.col("o_orderkey").alias("data_id"), original.alias("original_query"), F.coalesce("extra", F.lit("")).alias("expanded_query"),
        tx.append_requirements(original, F.col("extra")).alias("query"),
    )
    return resume.publish_rows(results)[0].select("ord", "data_id", "query")


_ROUTED = f"""{FLOW_SQL}, ex AS (SELECT query_id, string_agg(skill, ', ' ORDER BY rank) AS extra FROM rk WHERE rank <= 3 GROUP BY query_id),
ft AS MATERIALIZED (SELECT q.query_id, query, extra, query || CASE WHEN extra IS NULL THEN '' ELSE chr(10) || chr(10) || extra END AS fresh FROM route_query q LEFT JOIN ex ON ex.query_id = q.query_id),
pub AS MATERIALIZED (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'cached' WHEN extra IS NULL THEN 'unchanged' WHEN query_id % 4 = 1 THEN 'revised' ELSE 'verbatim' END AS origin,
  CASE WHEN query_id % 4 = 0 THEN 'kept ' || query WHEN extra IS NOT NULL AND query_id % 4 = 1 THEN fresh || ' (checked)' ELSE fresh END AS text FROM ft WHERE NOT (query_id % 4 = 3 AND extra IS NOT NULL))"""


def _expanded(v):
    """Routed requests with their text and where it comes from (``ord, data_id, original_query, expanded_query, query, origin``).

    A stored result is used again where its input is the present one (ids divisible by 4; those
    with remainder 2 hold an older input).  A review may keep the text word for word, or change
    it and name an issue (remainder 1); a review that changes it without one breaks the contract
    (remainder 3), and its request is not published.
    """
    live = cut_lineage(graph.resolve_merges(v.skill))
    chosen, alike = chosen_nodes(v)
    ranked = ranking.rank_topk(reviewed(v, live, chosen, 3), "query_id", ["seen"], 3)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "skill"))), lambda x: x["skill"]), ", ")
    extra = ranked.groupBy(F.col("query_id").alias("like")).agg(names.alias("extra"))
    asked = v.route_query.select("query_id", "query").join(alike, "query_id", "left").join(extra, "like", "left").drop("like")
    turn, digest = F.col("query_id") % 4, F.md5("query")
    rows = cut_lineage(asked.withColumns({"expanded": tx.append_requirements(F.col("query"), F.col("extra")), "digest": digest}))
    stored = rows.where(turn.isin(0, 2)).select("query_id", F.when(turn == 0, F.col("digest")).otherwise("older").alias("stored"), F.lit(True).alias("has_review"))
    state = resume.resume_state(rows.select("query_id", "digest"), stored, "query_id", "digest", "stored")
    todo = rows.join(state.where("state = 'new'"), "query_id", "left_semi")
    routed = F.col("extra").isNotNull()
    review = todo.select(
        "query_id", "query", "extra", "expanded", (~routed | turn.isin(0, 2)).alias("consistent"), F.when(routed & (turn == 1), 1).otherwise(0).alias("n_issues"),
        F.when(routed & turn.isin(1, 3), F.concat("expanded", F.lit(" (checked)"))).otherwise(F.col("expanded")).alias("final_query"),
    )
    judged = cut_lineage(resume.consistency_contract(review).where("ok"))
    origin = F.when(~routed, "unchanged").when(F.col("consistent"), "verbatim").otherwise("revised")
    fresh = judged.select("query_id", F.col("query").alias("original_query"), F.coalesce("extra", F.lit("")).alias("expanded_query"), F.col("kept").alias("text"), origin.alias("origin"))
    cached = rows.join(state.where("state = 'fully_cached'"), "query_id", "left_semi").select(
        "query_id", F.col("query").alias("original_query"), F.lit("").alias("expanded_query"), F.concat(F.lit("kept "), "query").alias("text"), F.lit("cached").alias("origin")
    )
    done = cut_lineage(fresh.unionByName(cached))
    numbered = done.join(ordered.positions(done.select("query_id"), [], ["query_id"], "ord"), "query_id")
    return numbered.select("ord", F.col("query_id").alias("data_id"), "original_query", "expanded_query", F.col("text").alias("query"), "origin")


@query(
    "flow_expand_routed",
    f"""WITH {_ROUTED} SELECT row_number() OVER (ORDER BY query_id) AS ord, query_id AS data_id, origin, md5(text) AS digest FROM pub""",
    ROUTE_VIEWS,
)
def flow_expand_routed(v):
    """Requests routed, reviewed, resumed, checked and published; the published files are read back."""
    out = _scratch(v)
    results = cut_lineage(_expanded(v))
    expanded, audit = results.select("ord", "data_id", "query"), results.select("ord", "data_id", "origin", "original_query", "expanded_query")
    sinks.publish_split(expanded, audit, out)
    got = v.spark.read.schema("ord long, data_id long, query string").json(f"{out}/expanded")
    told = v.spark.read.schema("ord long, data_id long, origin string").json(f"{out}/audit")
    return got.join(told.select("data_id", "origin"), "data_id").select("ord", "data_id", "origin", F.md5("query").alias("digest"))


@query(
    "flow_expand_summary",
    f"""WITH {_ROUTED} SELECT 'expand' AS stage, origin AS state, count(*) AS n FROM pub GROUP BY origin UNION ALL SELECT 'expand', 'all', count(*) FROM pub""",
    ROUTE_VIEWS,
)
def flow_expand_summary(v):
    """The stage's one-object summary, written and read back."""
    out = f"{_scratch(v)}/summary"
    sinks.run_summary("expand", _expanded(v), "origin", out, {"longest": F.max(F.length("query"))})
    return sinks.read_summary(v.spark, out)
