"""Ranking, window, sampling and budget queries."""

from pyspark.sql import functions as F

from routeloom.functions import text as tx
from routeloom.operators import ordered, ranking
from routeloom.plans.registry import query
from routeloom.plans.q_text import _BROKEN

_RANKED = """SELECT l_orderkey, skill, score, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY l_orderkey ORDER BY score DESC, ln, l_partkey) AS rank FROM line WHERE applicable) WHERE rank <= 10"""


@query("rank_topk", _RANKED, ("line",))
def rank_topk(v):
    return ranking.rank_topk(v.line, "l_orderkey", ["ln", "l_partkey"]).select("l_orderkey", "skill", "score", "rank")


@query(
    "review_batches",
    """SELECT l_orderkey, skill, (pos - 1) // 8 AS batch, (pos - 1) % 8 AS slot FROM (SELECT *,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY ln, l_partkey) AS pos FROM line)""",
    ("line",),
)
def review_batches(v):
    return ranking.review_batches(v.line, ["l_orderkey"], ["ln", "l_partkey"]).select("l_orderkey", "skill", "batch", "slot")


@query(
    "round_robin_sample",
    """SELECT doc_id, source, turn FROM (SELECT doc_id, source,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 150""",
)
def round_robin_sample(v):
    docs = v.table("documents").select("doc_id", "source")
    return ranking.round_robin_sample(docs, "source", ["doc_id"], 150).select("doc_id", "source", "turn")


@query(
    "keep_first",
    """SELECT digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies
FROM wanted GROUP BY digest""",
    ("wanted",),
)
def keep_first(v):
    first = ordered.first_row(v.wanted.select("digest", "doc_id", "source"), ["digest"], ["doc_id"])
    copies = v.wanted.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    return first.join(copies, "digest")


@query(
    "char_budget",
    """SELECT source, doc_id, md5(substr(text, 1, 50000 - used)) AS digest, length(text) > 50000 - used AS truncated
FROM (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM documents) WHERE used < 50000""",
)
def char_budget(v):
    docs = v.table("documents").select("source", "doc_id", "text")
    kept = ranking.char_budget(docs, ["source"], ["doc_id"], "text", 50_000)
    return kept.select("source", "doc_id", F.md5("text").alias("digest"), "truncated")


_SIG = f"(regexp_matches(l, '{tx.SOURCE_SIGNAL}') OR regexp_matches(l, '{tx.COMPOSITION_SIGNAL}'))"


@query(
    "line_context",
    f"""WITH ln AS (SELECT doc_id, i, lines[i] AS l FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM term_doc))),
f AS (SELECT doc_id, i, l, max(CAST({_SIG} AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM ln)
SELECT doc_id, i AS line_no, md5(l) AS digest FROM f WHERE near = 1""",
    ("term_doc",),
)
def line_context(v):
    lines = v.term_doc.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    lines = lines.select("doc_id", (F.col("p") + 1).alias("line_no"), "l", tx.signal_line(F.col("l")).alias("hit"))
    near = ranking.line_context(lines, ["doc_id"], "line_no", "hit")
    return near.select("doc_id", "line_no", F.md5("l").alias("digest"))


@query(
    "evidence_excerpt",
    f"""WITH src AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS site,
  lpad(CAST(page_id AS VARCHAR), 12, '0') || '.html' AS path,
  regexp_replace(html, 'data:[^;"'']+;base64,[A-Za-z0-9+/=]{{256,}}', '[embedded-data-removed]', 'g') AS html FROM page_source),
files AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY path) AS file_no FROM src),
ln AS (SELECT site, path, file_no, i, n, lines[i] AS l FROM (SELECT *, len(lines) AS n, unnest(range(1, len(lines) + 1)) AS i FROM
  (SELECT site, path, file_no, string_split(regexp_replace({_BROKEN}, '\\n$', ''), chr(10)) AS lines FROM files WHERE file_no <= 80))),
lab AS (SELECT *, i || ': ' || substr(l, 1, 1200) AS label, {_SIG} AS hit FROM ln),
pairs AS (SELECT h.site, h.path, h.file_no, h.i AS h, c.i, c.label FROM lab h JOIN lab c
  ON h.path = c.path AND h.site = c.site AND abs(h.i - c.i) <= 2 WHERE h.hit),
hits AS (SELECT site, path, file_no, h, sum(length(label)) AS size FROM pairs GROUP BY ALL),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY site, path ORDER BY h
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM hits),
kept AS (SELECT DISTINCT p.site, p.path, p.file_no, p.i, p.label FROM pairs p JOIN run r
  ON r.site = p.site AND r.path = p.path AND r.h = p.h WHERE r.used < 18000),
blocks AS (SELECT site, path, file_no, 'FILE ' || path || chr(10) || string_agg(label, chr(10) ORDER BY i) AS block
  FROM kept GROUP BY site, path, file_no),
spent AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY site ORDER BY file_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM blocks)
SELECT site, path, md5(substr(block, 1, 50000 - used)) AS digest, length(block) > 50000 - used AS truncated
FROM spent WHERE used < 50000""",
    ("page_source",),
)
def evidence_excerpt(v):
    files = v.page_source.select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("site"),
        F.concat(F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(".html")).alias("path"),
        F.lit(1).alias("pref"),
        "html",
    )
    got = ranking.evidence_excerpt(files, "site", "path", "html", F.lit(".html"), F.lit(False))
    return got.select("site", "path", F.md5("block").alias("digest"), "truncated")


@query(
    "dense_ids",
    "SELECT name, 'public-skill-' || lpad(CAST(row_number() OVER (ORDER BY name) AS VARCHAR), 6, '0') AS id FROM node",
    ("node",),
)
def dense_ids(v):
    return ranking.dense_ids(v.node.select("name"), ["name"], "id", "public-skill-%06d")


@query(
    "slice_rows",
    "SELECT doc_id, source FROM documents ORDER BY doc_id OFFSET 50",
)
def slice_rows(v):
    return ranking.slice_rows(v.table("documents").select("doc_id", "source"), ["doc_id"], 50)


@query(
    "first_writer_wins",
    """SELECT skill, arg_min(description, step) AS description, min(step) AS step FROM decision
WHERE op = 'revise' GROUP BY skill""",
    ("decision",),
)
def first_writer_wins(v):
    edits = v.decision.where("op = 'revise'").select("skill", "description", "step")
    return ordered.first_row(edits, ["skill"], ["step"])


@query(
    "hit_flags",
    f"""WITH r AS ({_RANKED}), s AS (SELECT l_orderkey, 'part_' || max(l_partkey) AS source FROM line GROUP BY 1)
SELECT s.l_orderkey AS query_id, coalesce(rank <= 1, false) AS hit_1, coalesce(rank <= 5, false) AS hit_5,
  coalesce(rank <= 10, false) AS hit_10 FROM s LEFT JOIN r ON r.l_orderkey = s.l_orderkey AND r.skill = s.source""",
    ("line",),
)
def hit_flags(v):
    ranks = source_ranks(v)
    return ranks.select("query_id", *[c.alias(n) for n, c in ranking.hit_flags(F.col("source_rank")).items()])


def source_ranks(v):
    """Nullable rank of each request's source in its final ranking."""
    sources = v.line.groupBy("l_orderkey").agg(F.max("l_partkey").alias("p"))
    sources = sources.select(
        F.col("l_orderkey").alias("query_id"), F.concat(F.lit("part_"), F.col("p").cast("string")).alias("skill")
    )
    ranked = ranking.rank_topk(v.line, "l_orderkey", ["ln", "l_partkey"]).select(
        F.col("l_orderkey").alias("query_id"), "skill", F.col("rank").alias("source_rank")
    )
    return sources.join(ranked, ["query_id", "skill"], "left")


@query(
    "request_levels",
    """SELECT conv_id, level, md5(string_agg(t, chr(10)) OVER (PARTITION BY conv_id ORDER BY lv)) AS digest FROM (
  SELECT conv_id, least(turn, 2) AS lv, CASE least(turn, 2) WHEN 0 THEN 'goal' WHEN 1 THEN 'experience' ELSE 'interaction' END AS level,
    string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY ALL)""",
)
def request_levels(v):
    """All turns of a talk: the first is the goal, the second the experience, later ones are interaction."""
    levels = ["goal", "experience", "interaction"]
    at = F.least(F.col("turn"), F.lit(2)).cast("int")
    rows = v.table("conversations").withColumn("level", F.element_at(F.array(*[F.lit(x) for x in levels]), at + 1))
    got = ranking.cumulative_texts(rows, "conv_id", "level", "text", levels, "turn")
    return got.select("conv_id", "level", F.md5("request").alias("digest"))
