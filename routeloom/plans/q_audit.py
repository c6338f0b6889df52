"""Counting, summary and quality-audit queries."""

from pyspark.sql import functions as F

from routeloom.functions import text as tx
from routeloom.operators import graph, ordered, ranking, similarity
from routeloom.plans.q_graph import FLOW_SQL, ROUTE_VIEWS, _QWORDS, retrieved
from routeloom.plans.q_text import _NORM
from routeloom.plans.registry import query

_CONV = f"""c AS MATERIALIZED (SELECT conv_id, turn, text, {_NORM.format('text')} AS norm, {_QWORDS.format('text')} AS w,
  len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS n_words FROM conversations),
p AS MATERIALIZED (SELECT a.conv_id, len(list_intersect(a.w, b.w)) * 1.0 / greatest(1, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS j
  FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn)"""


def _pairs(v):
    rows = v.table("conversations").select("conv_id", "turn", tx.token_set(F.col("text")).alias("w"))
    return similarity.pair_audit(rows, "conv_id", "turn", "w")


@query(
    "quality_audit_per_skill",
    f"""WITH {_CONV}, s AS (SELECT conv_id, count(*) FILTER (WHERE j >= 0.8) AS high_pairs, max(j) AS top FROM p GROUP BY conv_id)
SELECT c.conv_id, count(*) AS queries, round(coalesce(any_value(top), 0), 4) AS max_jaccard, coalesce(any_value(high_pairs), 0) AS high_pairs,
  count(*) FILTER (WHERE regexp_matches(text, '{tx.TECHNOLOGY_TERMS}')) AS term_hits FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id""",
)
def quality_audit_per_skill(v):
    hits = v.table("conversations").groupBy("conv_id").agg(F.count_if(tx.technology_hit(F.col("text"))).alias("term_hits"))
    return _pairs(v).join(hits, "conv_id").select(
        "conv_id", F.col("rows").alias("queries"), F.round("max_jaccard", 4).alias("max_jaccard"), "high_pairs", "term_hits"
    )


@query(
    "quality_audit",
    f"""WITH {_CONV} SELECT count(DISTINCT conv_id) AS skills, count(*) AS queries, count(DISTINCT norm) AS unique_normalized,
  (SELECT count(*) FROM (SELECT norm FROM c GROUP BY norm HAVING count(*) > 1)) AS duplicate_groups, min(n_words) AS min_words, max(n_words) AS max_words,
  round(avg(n_words), 3) AS mean_words, (SELECT count(*) FROM p) AS pairs, (SELECT count(*) FILTER (WHERE j >= 0.8) FROM p) AS high_pairs,
  (SELECT round(count(*) FILTER (WHERE j >= 0.8) * 1.0 / count(*), 6) FROM p) AS high_rate, (SELECT round(max(j), 4) FROM p) AS max_jaccard,
  count(*) FILTER (WHERE regexp_matches(text, '{tx.TECHNOLOGY_TERMS}')) AS term_hits FROM c""",
)
def quality_audit(v):
    norm = v.table("conversations").groupBy(F.md5(tx.normalize_text(F.col("text"))).alias("norm")).agg(F.count(F.lit(1)).alias("n"))
    dup = norm.agg(F.count(F.lit(1)).alias("unique_normalized"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))
    words = tx.word_count(F.col("text"))
    totals = v.table("conversations").agg(
        F.countDistinct("conv_id").alias("skills"), F.count(F.lit(1)).alias("queries"), F.min(words).alias("min_words"),
        F.max(words).alias("max_words"), F.round(F.avg(words), 3).alias("mean_words"),
        F.count_if(tx.technology_hit(F.col("text"))).alias("term_hits"),
    )
    pairs = _pairs(v).agg(
        F.sum("pairs").alias("pairs"), F.sum("high_pairs").alias("high_pairs"),
        F.round(F.coalesce(F.sum("high_pairs") / F.nullif(F.sum("pairs"), F.lit(0)), F.lit(0.0)), 6).alias("high_rate"),
        F.round(F.max("max_jaccard"), 4).alias("max_jaccard"),
    )
    one = lambda d: d.withColumn("k", F.lit(1))
    return one(totals).join(one(dup), "k").join(one(pairs), "k").drop("k")


@query(
    "group_pairs",
    f"""WITH d AS (SELECT source, doc_id, list_sort({_QWORDS.format('text')}) AS w FROM documents),
s AS MATERIALIZED (SELECT source, w, count(*) AS copies, min(doc_id) AS k FROM d GROUP BY source, w)
SELECT source, least(kx, ky) AS a, greatest(kx, ky) AS b, CASE WHEN kx < ky THEN cx ELSE cy END AS copies_a,
  CASE WHEN kx < ky THEN cy ELSE cx END AS copies_b, round(j, 6) AS jaccard FROM (SELECT x.source, x.k AS kx, y.k AS ky, x.copies AS cx,
  y.copies AS cy, len(list_intersect(x.w, y.w)) * 1.0 / greatest(1, len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) AS j
  FROM s x JOIN s y ON x.source = y.source AND x.k < y.k WHERE least(len(x.w), len(y.w)) >= 0.79 * greatest(len(x.w), len(y.w))) WHERE j >= 0.8""",
)
def group_pairs(v):
    """Near copies inside a source: pairs of distinct token sets, copies counted."""
    rows = v.table("documents").select("source", "doc_id", tx.token_set(F.col("text")).alias("w"))
    from routeloom.session import cut_lineage

    sets = cut_lineage(similarity.token_sets(rows, "source", "doc_id", "w"))
    got = similarity.similar_sets(sets, "source", 0.8)
    first = F.col("kx") < F.col("ky")
    return got.select(
        "source", F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"),
        F.when(first, F.col("cx")).otherwise(F.col("cy")).alias("copies_a"),
        F.when(first, F.col("cy")).otherwise(F.col("cx")).alias("copies_b"), F.round("jaccard", 6).alias("jaccard"),
    )


@query(
    "normalized_duplicates",
    f"""SELECT md5(norm) AS digest, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM
  (SELECT {_NORM.format('text')} AS norm, source, doc_id FROM documents) GROUP BY norm HAVING count(*) > 1""",
)
def normalized_duplicates(v):
    rows = v.table("documents").select(F.md5(tx.normalize_text(F.col("text"))).alias("digest"), "source", "doc_id")
    return rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_doc")
    ).where("n > 1")


@query(
    "group_size_stats",
    """SELECT count(*) AS groups, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean_size, sum(n)::BIGINT AS rows,
  round(count(*) * 1.0 / sum(n), 6) AS fraction, string_agg(n || 'x' || c, ',' ORDER BY n) FILTER (WHERE first) AS histogram FROM
  (SELECT n, count(*) OVER (PARTITION BY n) AS c, row_number() OVER (PARTITION BY n) = 1 AS first FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label))""",
)
def group_size_stats(v):
    sizes = v.table("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    by_size = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    packed = F.array_sort(F.collect_list(F.struct("n", "c")))
    return by_size.agg(
        F.sum("c").alias("groups"), F.min("n").alias("smallest"), F.max("n").alias("largest"),
        F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 6).alias("mean_size"), F.sum(F.col("n") * F.col("c")).alias("rows"),
        F.round(F.sum("c") / F.sum(F.col("n") * F.col("c")), 6).alias("fraction"),
        F.array_join(F.transform(packed, lambda s: F.concat(s["n"].cast("string"), F.lit("x"), s["c"].cast("string"))), ",").alias("histogram"),
    )


@query(
    "group_size_histogram",
    "SELECT n, count(*) AS groups FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY n",
)
def group_size_histogram(v):
    """How many groups have each size: one row per size, however many sizes there are."""
    sizes = v.table("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


@query(
    "csr_offsets",
    """SELECT label, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  sum(n) OVER (ORDER BY label)::BIGINT AS stop FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""",
)
def csr_offsets(v):
    counts = v.table("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    got = ordered.running(counts, [], ["label"], {"start": ("sum", F.col("n"), False)})
    return got.select("label", "start", (F.col("start") + F.col("n")).alias("stop"))


@query(
    "catalog_counts",
    """SELECT (SELECT count(*) FROM node WHERE is_root) AS roots, (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM skill) AS identities,
  (SELECT count(*) FROM skill WHERE merged_into IS NULL) AS active, (SELECT count(*) FROM member) AS memberships, (SELECT count(*) FROM edge) AS edges""",
    ("node", "edge", "member", "skill"),
)
def catalog_counts(v):
    parts = [
        v.node.agg(F.count_if("is_root").alias("roots"), F.count(F.lit(1)).alias("nodes")),
        v.skill.agg(F.count(F.lit(1)).alias("identities"), F.count_if(F.col("merged_into").isNull()).alias("active")),
        v.member.agg(F.count(F.lit(1)).alias("memberships")),
        v.edge.agg(F.count(F.lit(1)).alias("edges")),
    ]
    out = parts[0].withColumn("k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("k", F.lit(1)), "k")
    return out.drop("k")


@query(
    "longest_variant",
    "SELECT source, lang, md5(arg_max(text, (length(text), text))) AS digest, max(length(text)) AS n FROM documents GROUP BY source, lang",
)
def longest_variant(v):
    return v.table("documents").groupBy("source", "lang").agg(
        F.md5(F.max_by("text", F.struct(F.length("text"), "text"))).alias("digest"), F.max(F.length("text")).alias("n")
    )


@query(
    "run_status_counts",
    """SELECT source, count(*) AS selected, count(*) FILTER (WHERE quality = 1) AS success, count(*) FILTER (WHERE quality = 0) AS failed,
  count(*) FILTER (WHERE quality IS NULL) AS skipped, sum(CASE WHEN quality = 1 THEN len(string_split(text, chr(10))) ELSE 0 END)::BIGINT AS segments
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def run_status_counts(v):
    rows = v.table("documents").join(v.table("labels").select("doc_id", "quality"), "doc_id", "left")
    ok = F.col("quality") == 1
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(ok).alias("success"), F.count_if(F.col("quality") == 0).alias("failed"),
        F.count_if(F.col("quality").isNull()).alias("skipped"),
        F.sum(F.when(ok, F.size(F.split("text", "\n"))).otherwise(0)).alias("segments"),
    )


_DISP = """r AS (SELECT l_orderkey, skill FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, ln, l_partkey) AS rank
  FROM line WHERE applicable) WHERE rank <= 3),
disp AS MATERIALIZED (SELECT b.l_orderkey, b.skill, CASE WHEN r.skill IS NOT NULL THEN 'accept' ELSE 'reject' END AS decision
  FROM line b LEFT JOIN r ON r.l_orderkey = b.l_orderkey AND r.skill = b.skill)"""


def _dispositions(v):
    """accept iff applicable and among the final three, else reject."""
    top = ranking.rank_topk(v.line, "l_orderkey", ["ln", "l_partkey"], 3).select("l_orderkey", "skill", F.lit("accept").alias("_d"))
    return v.line.select("l_orderkey", "skill").join(top, ["l_orderkey", "skill"], "left").select(
        "l_orderkey", "skill", F.coalesce("_d", F.lit("reject")).alias("decision")
    )


@query("decision_disposition", f"WITH {_DISP} SELECT * FROM disp", ("line",))
def decision_disposition(v):
    return _dispositions(v)


_PER = """per AS (SELECT l_orderkey, count(*) AS reviewed, count(*) FILTER (WHERE decision = 'accept') AS accepted FROM disp GROUP BY 1)"""


@query(
    "expansion_summary",
    f"""WITH {_DISP}, {_PER} SELECT count(*) AS queries, count(*) FILTER (WHERE accepted > 0) AS changed, count(*) FILTER (WHERE accepted = 0) AS unchanged,
  sum(reviewed)::BIGINT AS reviewed, sum(accepted)::BIGINT AS accepted, sum(reviewed - accepted)::BIGINT AS rejected,
  count(*) FILTER (WHERE accepted < reviewed) AS with_rejection, round(avg(reviewed), 6) AS mean_candidates FROM per""",
    ("line",),
)
def expansion_summary(v):
    per = _dispositions(v).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("decision") == "accept").alias("accepted")
    )
    acc, rev = F.col("accepted"), F.col("reviewed")
    return per.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(acc > 0).alias("changed"), F.count_if(acc == 0).alias("unchanged"),
        F.sum(rev).alias("reviewed"), F.sum(acc).alias("accepted"), F.sum(rev - acc).alias("rejected"),
        F.count_if(acc < rev).alias("with_rejection"), F.round(F.avg(rev), 6).alias("mean_candidates"),
    )


@query(
    "selection_count_distribution",
    f"""WITH {FLOW_SQL} SELECT n, count(*) AS queries FROM (SELECT query_id, count(DISTINCT name) AS n FROM chosen GROUP BY query_id) GROUP BY n""",
    ROUTE_VIEWS,
)
def selection_count_distribution(v):
    chosen = graph.route_dag(v.route_query, v.node, v.edge)
    per = chosen.groupBy("query_id").agg(F.countDistinct("name").alias("n"))
    return per.groupBy("n").agg(F.count(F.lit(1)).alias("queries"))


@query(
    "miss_stage",
    f"""WITH {FLOW_SQL} SELECT s.query_id, CASE WHEN c.skill IS NULL THEN 'root_route' WHEN coalesce(rank, 11) > 10 THEN 'candidate_rank' ELSE 'none' END AS stage
FROM src s LEFT JOIN cand c ON c.query_id = s.query_id AND c.skill = s.source LEFT JOIN rk ON rk.query_id = s.query_id AND rk.skill = s.source""",
    ROUTE_VIEWS,
)
def miss_stage(v):
    from routeloom.operators.contracts import miss_stage_of

    return retrieved(v).select("query_id", miss_stage_of(F.col("covered"), F.col("source_rank"), 10).alias("stage"))


@query(
    "flow_retrieve_eval",
    f"""WITH {FLOW_SQL}, n AS (SELECT query_id, count(*) AS candidates FROM cand GROUP BY query_id),
e AS (SELECT s.query_id, c.skill IS NOT NULL AS covered, rank, coalesce(candidates, 0) AS candidates FROM src s
  LEFT JOIN cand c ON c.query_id = s.query_id AND c.skill = s.source LEFT JOIN rk ON rk.query_id = s.query_id AND rk.skill = s.source
  LEFT JOIN n ON n.query_id = s.query_id)
SELECT count(*) AS queries, round(avg(covered::INT), 6) AS coverage, round(avg(coalesce(rank <= 1, false)::INT), 6) AS r_at_1,
  round(avg(coalesce(rank <= 5, false)::INT), 6) AS r_at_5, round(avg(coalesce(rank <= 10, false)::INT), 6) AS r_at_10,
  round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_at_10, round(avg(candidates), 6) AS mean_candidates,
  round(quantile_cont(candidates, 0.5), 6) AS median_candidates FROM e""",
    ROUTE_VIEWS,
)
def flow_retrieve_eval(v):
    return retrieval_metrics(retrieved(v))


def retrieval_metrics(rows):
    """Coverage, R@1/5/10, MRR@10 over all requests, mean and median number of candidates."""
    rank = F.col("source_rank")
    share = lambda c, n: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6).alias(n)
    return rows.agg(
        F.count(F.lit(1)).alias("queries"), share(F.col("covered"), "coverage"), share(rank <= 1, "r_at_1"),
        share(rank <= 5, "r_at_5"), share(rank <= 10, "r_at_10"),
        F.round(F.avg(F.when(rank <= 10, 1.0 / rank).otherwise(0.0)), 6).alias("mrr_at_10"),
        F.round(F.avg("candidates"), 6).alias("mean_candidates"), F.round(F.median("candidates"), 6).alias("median_candidates"),
    )
