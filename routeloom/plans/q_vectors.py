"""Vector and clustering queries."""

from pyspark.sql import functions as F

from routeloom.functions import vector as vx
from routeloom.operators import vectors
from routeloom.plans.q_audit import retrieval_metrics
from routeloom.plans.registry import query
from routeloom.session import cut_lineage

#: A group is a candidate of a vector from this cosine with its mean on.
FLOOR = 0.01
_RANK = """s AS MATERIALIZED (SELECT vec_id, label, mean_label, list_dot_product(v, m) AS score FROM vector, mean),
rk AS MATERIALIZED (SELECT vec_id, rank, score >= 0.01 AS covered, candidates FROM (SELECT vec_id, label, mean_label, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, mean_label) AS rank,
  count(*) FILTER (WHERE score >= 0.01) OVER (PARTITION BY vec_id) AS candidates FROM s) WHERE label = mean_label)"""


def _ranks(v):
    vecs = v.vector
    means = cut_lineage(vectors.group_means(vecs, "label", "v"))
    return vectors.rank_among_means(vecs, means, "vec_id", "label", "v", floor=FLOOR)


@query("nearest_mean_rank", f"WITH {_RANK} SELECT vec_id, rank FROM rk", ("vector", "mean"))
def nearest_mean_rank(v):
    return _ranks(v).select("vec_id", "rank")


@query(
    "retrieval_eval",
    f"""WITH {_RANK} SELECT count(*) AS queries, round(avg(covered::INT), 6) AS coverage, round(avg((covered AND rank <= 1)::INT), 6) AS r_at_1,
  round(avg((covered AND rank <= 5)::INT), 6) AS r_at_5, round(avg((covered AND rank <= 10)::INT), 6) AS r_at_10,
  round(avg(CASE WHEN covered AND rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_at_10,
  round(avg(candidates), 6) AS mean_candidates, round(quantile_cont(candidates, 0.5), 6) AS median_candidates FROM rk""",
    ("vector", "mean"),
)
def retrieval_eval(v):
    """Groups that a vector comes close enough to are its candidates; its own may be missing."""
    covered = F.col("own_score") >= FLOOR
    rows = _ranks(v).select("vec_id", F.when(covered, F.col("rank")).alias("source_rank"), covered.alias("covered"), "candidates")
    return retrieval_metrics(rows)


@query(
    "vector_contract",
    """SELECT label, count(*) AS n, count(DISTINCT vec_id) = count(*) AS unique_keys, min(len(v)) = max(len(v)) AS same_dim,
  count(*) FILTER (WHERE abs(sqrt(list_dot_product(v, v)) - 1) > 1e-5) AS bad_norms, count(*) = (SELECT max(n) FROM
  (SELECT count(*) AS n FROM vector GROUP BY label)) AS full_group FROM vector GROUP BY label""",
    ("vector",),
)
def vector_contract(v):
    per = v.vector.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), (F.countDistinct("vec_id") == F.count(F.lit(1))).alias("unique_keys"),
        (F.min(F.size("v")) == F.max(F.size("v"))).alias("same_dim"),
        F.count_if(F.abs(vx.norm(F.col("v")) - 1) > 1e-5).alias("bad_norms"),
    )
    full = v.vector.groupBy("label").count().agg(F.max("count").alias("m")).first()["m"]
    return per.withColumn("full_group", F.col("n") == full)


@query(
    "vector_pairs",
    """WITH p AS MATERIALIZED (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 12) AS s FROM vector a JOIN vector b
  ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT vec_id, arg_min(other, (-s, other)) AS best_key, round(max(s), 6) AS best, count(*) FILTER (WHERE s >= 0.5) AS n_above FROM p GROUP BY vec_id""",
    ("vector",),
)
def vector_pairs(v):
    got = vectors.nearest_in_group(v.vector, "label", "vec_id", "v", 0.5)
    return got.withColumn("best", F.round("best", 6))


@query(
    "cosine_diversity",
    """SELECT a.label, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.95), 6) AS p95, round(max(s), 6) AS max
FROM (SELECT a.label, list_dot_product(a.v, b.v) AS s FROM vector a JOIN vector b ON a.label = b.label AND a.vec_id < b.vec_id) a GROUP BY a.label""",
    ("vector",),
)
def cosine_diversity(v):
    got = vectors.cosine_diversity(v.vector, "label", "vec_id", "v")
    return got.select("label", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "max")])


def _fits(v):
    return cut_lineage(vectors.group_mixture(v.vector, "label", "vec_id", "v"))


@query("group_mixture")
def group_mixture(v):
    return _fits(v).select("label", "k", F.round("bic", 3).alias("bic"), "converged", "iterations", "n", "fitted")


#: Candidate fits of every user: three to five criteria each, with ties, and users without a fit.
_FITS_SQL = """ft AS MATERIALIZED (SELECT user_id AS g, 2 + event_id % 5 AS k, CASE WHEN user_id % 11 = 0 THEN NULL ELSE floor(min(value) * 4) END AS bic, max(value) > 30 AS converged, count(*) AS n
  FROM events GROUP BY user_id, event_id % 5),
bs AS MATERIALIZED (SELECT * FROM ft QUALIFY row_number() OVER (PARTITION BY g ORDER BY bic NULLS FIRST, k) = 1)"""


def _fit_table(v):
    per = v.table("events").groupBy(F.col("user_id").alias("g"), (2 + F.col("event_id") % 5).alias("k")).agg(
        F.floor(F.min("value") * 4).cast("double").alias("bic"), (F.max("value") > 30).alias("converged"), F.count(F.lit(1)).alias("n")
    )
    return per.withColumn("bic", F.when(F.col("g") % 11 != 0, F.col("bic")))


@query("bic_select", f"WITH {_FITS_SQL} SELECT g, k, bic, n FROM bs")
def bic_select(v):
    """The smallest criterion of each group's fits, ties to fewer components."""
    return vectors.bic_select(_fit_table(v), "g").select("g", "k", "bic", "n")


@query(
    "component_histogram",
    f"""WITH {_FITS_SQL} SELECT k, count(*) AS groups, count(*) FILTER (WHERE converged) AS converged, round(k * count(*) * 1.0 / (SELECT sum(n) FROM ft), 6) AS components_per_row,
  round(min(bic), 6) AS best, 64 AS dimensions FROM bs GROUP BY k""",
)
def component_histogram(v):
    """Chosen component counts over the fits: groups, convergence, compression, best criterion and dimensions."""
    fits = _fit_table(v)
    rows = fits.agg(F.sum("n").alias("n")).first()["n"] or 1
    return vectors.mixture_summary(vectors.bic_select(fits, "g"), rows, 64)


@query("mixture_choice")
def mixture_choice(v):
    """The mixtures that the embedding groups get, end to end (compared with a plain fit in the tests)."""
    return vectors.mixture_summary(vectors.bic_select(_fits(v), "label"), v.vector.count(), 64)


_MEDOID_SQL = """cm AS (SELECT label, comp, list(x ORDER BY i) AS m FROM (SELECT label, vec_id % 3 AS comp, i, avg(v[i]) AS x FROM
  (SELECT vec_id, label, v, unnest(range(1, len(v) + 1)) AS i FROM vector) GROUP BY ALL) GROUP BY label, comp),
sc AS MATERIALIZED (SELECT vector.label, comp, vec_id, round(list_dot_product(v, m) / sqrt(list_dot_product(m, m)), 12) AS cosine FROM vector JOIN cm ON cm.label = vector.label),
m0 AS (SELECT * FROM sc WHERE comp = 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) = 1),
m1 AS (SELECT * FROM sc WHERE comp = 1 AND (label, vec_id) NOT IN (SELECT (label, vec_id) FROM m0) QUALIFY row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) = 1),
m2 AS (SELECT * FROM sc WHERE comp = 2 AND (label, vec_id) NOT IN (SELECT (label, vec_id) FROM m0 UNION ALL SELECT (label, vec_id) FROM m1)
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) = 1),
md AS MATERIALIZED (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2)"""


def _medoids(v):
    """Three means per label, by id; the second and third skip what an earlier one took."""
    comp = v.vector.withColumn("part", F.struct("label", (F.col("vec_id") % 3).cast("int").alias("component")))
    means = vectors.group_means(comp, "part", "v").select("part.label", "part.component", vx.l2_normalize(F.col("mean")).alias("mean"))
    return vectors.distinct_medoids(v.vector, means, "label", "vec_id", "v")


@query("distinct_medoids", f"WITH {_MEDOID_SQL} SELECT label, comp AS component, vec_id, round(cosine, 9) AS cosine FROM md", ("vector",))
def distinct_medoids(v):
    return _medoids(v).withColumn("cosine", F.round("cosine", 9))


@query(
    "medoid_ids",
    f"""WITH {_MEDOID_SQL} SELECT printf('pqr-medoid-%04d-%02d', label, CAST(comp AS INTEGER)) AS representative_id, label, comp AS component, vec_id, round(cosine, 8) AS component_medoid_cosine,
  'representative_potential_query' AS role FROM md""",
    ("vector",),
)
def medoid_ids(v):
    return _medoids(v).select(
        F.format_string("pqr-medoid-%04d-%02d", "label", "component").alias("representative_id"), "label", "component", "vec_id",
        F.round("cosine", 8).alias("component_medoid_cosine"), F.lit("representative_potential_query").alias("role"),
    )


@query(
    "embed_texts",
    r"""SELECT doc_id, kind, CASE WHEN ok THEN 256 END AS dims, CASE WHEN ok THEN 1.0::DOUBLE END AS length, CASE WHEN ok THEN 'ok' WHEN blank THEN 'blank' ELSE 'no_direction' END AS state FROM (
  SELECT *, trim(coalesce(t, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank, regexp_matches(coalesce(t, ''), '[\pL\pN]') AS ok FROM (SELECT doc_id, kind, CASE kind WHEN 0 THEN text WHEN 1 THEN NULL WHEN 2 THEN ' '
  WHEN 3 THEN '图像文本 ' || doc_id WHEN 4 THEN 'สวัสดี' ELSE '!? --' END AS t FROM (SELECT *, doc_id % 6 AS kind FROM documents)))""",
)
def embed_texts(v):
    """Whole documents, and in their place nulls, blanks, Chinese, Thai and bare punctuation: each is a unit vector or has a stated reason."""
    kind = F.col("doc_id") % 6
    text = (
        F.when(kind == 0, F.col("text")).when(kind == 1, F.lit(None)).when(kind == 2, " ").when(kind == 3, F.concat(F.lit("图像文本 "), F.col("doc_id").cast("string")))
        .when(kind == 4, "สวัสดี").otherwise("!? --")
    )
    got = vectors.embed_texts(v.table("documents").select("doc_id", kind.alias("kind"), text.alias("text")), "text")
    size = F.size("embedding")
    return got.select(
        "doc_id", "kind", F.when(size > 0, size).alias("dims"), F.round(vx.norm(F.col("embedding").cast("array<double>")), 5).alias("length"), F.col("embedding_state").alias("state")
    )
