"""Scalar function queries (text, json, array, vector)."""

from pyspark.sql import functions as F

from routeloom.functions import text as tx, vector as vx
from routeloom.operators import vectors
from routeloom.plans.registry import query

_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = "list_distinct(list_filter(string_split(" + _NORM + ", ' '), lambda x: x <> ''))"


@query(
    "normalize_text",
    f"SELECT doc_id, md5({_NORM.format('text')}) AS digest, length({_NORM.format('text')}) AS n FROM documents",
)
def normalize_text(v):
    norm = tx.normalize_text(F.col("text"))
    return v.table("documents").select("doc_id", F.md5(norm).alias("digest"), F.length(norm).alias("n"))


@query(
    "collapse_ws",
    """SELECT doc_id, md5(flat) AS digest, CASE WHEN flat = '' THEN 0 ELSE len(string_split(flat, ' ')) END AS n_words
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents)""",
)
def collapse_ws(v):
    return v.table("documents").select(
        "doc_id",
        F.md5(tx.collapse_ws(F.col("text"))).alias("digest"),
        tx.word_count(F.col("text")).alias("n_words"),
    )


@query(
    "token_jaccard",
    f"""WITH t AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS s FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0 ELSE
  len(list_intersect(a.s, b.s)) * 1.0 / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 6) AS jaccard
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def token_jaccard(v):
    turns = v.table("conversations").select("conv_id", "turn", tx.token_set(F.col("text")).alias("s"))
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("s2"))
    return turns.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(tx.token_jaccard(F.col("s"), F.col("s2")), 6).alias("jaccard")
    )


@query(
    "scrub_data_uri",
    """SELECT page_id, md5(t) AS digest, length(html) - length(t) AS saved FROM (SELECT page_id, html,
  regexp_replace(html, 'data:[^;"'']+;base64,[A-Za-z0-9+/=]{256,}', '[embedded-data-removed]', 'g') AS t FROM page_source)""",
    ("page_source",),
)
def scrub_data_uri(v):
    t = tx.scrub_data_uri(F.col("html"))
    return v.page_source.select(
        "page_id", F.md5(t).alias("digest"), (F.length("html") - F.length(t)).alias("saved")
    )


_BROKEN = (
    "regexp_replace(regexp_replace(html, '>\\s*<', '>' || chr(10) || '<', 'g'), '([{};])', '\\1' || chr(10), 'g')"
)


@query(
    "break_markup",
    f"""SELECT page_id, md5(t) AS digest, len(string_split(t, chr(10))) AS n_lines
FROM (SELECT page_id, {_BROKEN} AS t FROM pages)""",
)
def break_markup(v):
    t = tx.break_markup(F.col("html"), F.lit(".html"))
    return v.table("pages").select("page_id", F.md5(t).alias("digest"), F.size(F.split(t, "\n")).alias("n_lines"))


@query(
    "signal_lines",
    f"""SELECT page_id, len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '{tx.SOURCE_SIGNAL}')
  OR regexp_matches(x, '{tx.COMPOSITION_SIGNAL}'))) AS n_signal
FROM (SELECT page_id, string_split({_BROKEN}, chr(10)) AS lines FROM pages)""",
)
def signal_lines(v):
    lines = F.split(tx.break_markup(F.col("html"), F.lit(".html")), "\n")
    return v.table("pages").select("page_id", lines.alias("lines")).select(
        "page_id",
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", tx.signal_line)).alias("n_signal"),
    )


@query("has_cjk", "SELECT doc_id, regexp_matches(text, '[㐀-鿿]') AS has_cjk FROM documents")
def has_cjk(v):
    return v.table("documents").select("doc_id", tx.has_cjk(F.col("text")).alias("has_cjk"))


@query(
    "technology_hits",
    f"""SELECT source, count(*) AS docs, count(*) FILTER (WHERE regexp_matches(text, '{tx.TECHNOLOGY_TERMS}')) AS hits
FROM term_doc GROUP BY source""",
    ("term_doc",),
)
def technology_hits(v):
    return v.term_doc.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(tx.technology_hit(F.col("text"))).alias("hits")
    )


@query(
    "name_shape",
    """SELECT name, regexp_full_match(name, '[a-z0-9]+(_[a-z0-9]+)*') AS snake,
  regexp_full_match(dashed, '[a-z0-9]+(-[a-z0-9]+)*') AND length(dashed) <= 64 AS kebab
FROM (SELECT name, replace(name, '_', '-') AS dashed FROM
  (SELECT name FROM node UNION ALL SELECT p_name || '-' || p_partkey FROM part_dag))""",
    ("node",),
)
def name_shape(v):
    parts = v.part_dag.select(F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("name"))
    names = v.node.select("name").unionByName(parts)
    return names.select(
        "name",
        tx.is_snake(F.col("name")).alias("snake"),
        tx.is_kebab(F.replace(F.col("name"), F.lit("_"), F.lit("-"))).alias("kebab"),
    )


@query(
    "safe_slug",
    """SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'),
  '^[._-]+|[._-]+$', '', 'g'), 1, 120), ''), 'skill') AS slug FROM pages""",
)
def safe_slug(v):
    return v.table("pages").select("page_id", tx.safe_slug(F.col("url")).alias("slug"))


@query(
    "reply_text",
    """SELECT doc_id, md5(regexp_replace(text || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || lang END, '^\\s+|\\s+$', '', 'g')) AS digest
FROM documents""",
)
def reply_text(v):
    """Plain contents with white space at the ends; lists with parts that are not shown."""
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    body = lambda c: F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("message"))).alias("choices")))
    listed = F.array(part("reasoning", F.lit("hidden")), part("text", F.col("text")), part("output_text", F.col("lang")), part("image", F.lit("x")))
    plain = F.concat(F.lit(" \t"), "text", F.lit("\n "))
    reply = F.when(F.col("doc_id") % 2 == 0, body(plain)).otherwise(body(listed))
    return v.table("documents").select("doc_id", F.md5(tx.reply_text(reply)).alias("digest"))


@query(
    "first_json_object",
    """SELECT doc_id, CASE WHEN doc_id % 8 = 3 THEN NULL ELSE doc_id END AS found,
  CASE doc_id % 8 WHEN 3 THEN NULL WHEN 6 THEN md5('```json ' || text || ' ```') ELSE md5(text) END AS digest FROM documents""",
)
def first_json_object(v):
    """Fenced, embedded, broken, followed and preceded by other braces, fences inside a value."""
    obj = F.to_json(F.struct("doc_id", "text"))
    fenced = F.to_json(F.struct("doc_id", F.concat(F.lit("```json "), "text", F.lit(" ```")).alias("text")))
    kind = F.col("doc_id") % 8
    reply = (
        F.when(kind == 0, obj)
        .when(kind == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here it is: "), obj, F.lit(" as asked")))
        .when(kind == 3, F.concat(F.lit("broken "), F.substring(obj, F.lit(1), F.length(obj) - 1)))
        .when(kind == 4, F.concat(obj, F.lit(' and {"b":2}')))
        .when(kind == 5, F.concat(F.lit("use {x} -> "), obj))
        .when(kind == 6, fenced)
        .otherwise(F.concat(obj, F.lit(" done }")))
    )
    found = v.table("documents").select("doc_id", tx.first_json_object(reply).alias("obj"))
    return found.select(
        "doc_id",
        F.get_json_object("obj", "$.doc_id").cast("long").alias("found"),
        F.md5(F.get_json_object("obj", "$.text")).alias("digest"),
    )


@query(
    "append_requirements",
    """SELECT doc_id, md5(CASE WHEN toxic = 1 THEN base ELSE base || chr(10) || chr(10) || 'keep ' || lang END) AS digest
FROM (SELECT d.doc_id, lang, coalesce(toxic, 0) AS toxic, regexp_replace(text || '  ', '\\s+$', '') AS base
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
)
def append_requirements(v):
    docs = v.table("documents").join(v.table("labels"), "doc_id", "left")
    extra = F.when(F.col("toxic") == 1, "  ").otherwise(F.concat(F.lit(" keep "), "lang", F.lit("\n")))
    return docs.select(
        "doc_id",
        F.md5(tx.append_requirements(F.concat("text", F.lit("  ")), extra)).alias("digest"),
    )


@query(
    "stable_session_id",
    f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' ||
  substr(h, 21, 12) AS session_id FROM (SELECT doc_id, sha1(unhex('{tx.URL_NAMESPACE}') || encode('v1:' || source || '|' || doc_id)) AS h FROM documents)""",
)
def stable_session_id(v):
    return v.table("documents").select(
        "doc_id", tx.stable_id(F.lit("v1"), F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("session_id")
    )


@query(
    "ordered_distinct",
    """SELECT conv_id, turn, len(u) AS n, md5(array_to_string(u, ' ')) AS digest FROM (
  SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) AS u FROM (
    SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM conversations))""",
)
def ordered_distinct(v):
    words = F.array_distinct(F.split(tx.collapse_ws(F.col("text")), " "))
    return v.table("conversations").select(
        "conv_id", "turn", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("digest")
    )


@query(
    "route_pool",
    """SELECT event_id, array_to_string(list_filter(p, lambda x, i: x <> '' AND list_position(p, x) = i), ',') AS pool FROM (
  SELECT event_id, list_concat([route], regexp_split_to_array('route_1, route_3  ' || route || ',' || phase, '[,\\s]+')) AS p
  FROM attempt)""",
    ("attempt",),
)
def route_pool(v):
    listed = F.concat(F.lit("route_1, route_3  "), "route", F.lit(","), "phase")
    return v.attempt.select("event_id", F.array_join(tx.route_pool(F.col("route"), listed), ",").alias("pool"))


@query(
    "l2_normalize",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS length, round(list_sum(u), 6) AS total
FROM (SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM
  (SELECT vec_id, list_transform(v, lambda x: x * (label + 1)) AS v, sqrt(list_sum(list_transform(v, lambda x: x * x * (label + 1) * (label + 1)))) AS n
   FROM vector))""",
    ("vector",),
)
def l2_normalize(v):
    scaled = v.vector.withColumn("v", F.transform("v", lambda x: x * (F.col("label") + 1)))
    unit = scaled.select("vec_id", vx.l2_normalize(F.col("v")).alias("u"))
    return unit.select(
        "vec_id",
        F.round(vx.norm(F.col("u")), 6).alias("length"),
        F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query(
    "dot_product",
    "SELECT vec_id, round(list_dot_product(v, m), 6) AS dot FROM vector JOIN mean ON label = mean_label",
    ("vector", "mean"),
)
def dot_product(v):
    means = vectors.group_means(v.vector, "label", "v")
    return v.vector.join(means, "label").select(
        "vec_id", F.round(vx.dot_product(F.col("v"), F.col("mean")), 6).alias("dot")
    )


@query("utc_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def utc_iso(v):
    return v.table("events").select("event_id", tx.utc_iso(F.col("ts")).alias("iso"))


@query(
    "prefixed_number",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'site' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') END AS site_id
FROM documents""",
)
def prefixed_number(v):
    number = F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")
    folder = F.when(F.col("lang") == "en", F.concat(number, F.lit("-"), "source")).otherwise(F.concat(F.lit("x"), number))
    return v.table("documents").select("doc_id", tx.prefixed_number(folder, "site").alias("site_id"))


@query(
    "candidate_key",
    "SELECT conv_id, turn, 'conv_' || conv_id || '__s' || lpad(CAST(turn AS VARCHAR), 2, '0') AS key FROM conversations",
)
def candidate_key(v):
    case = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"))
    return v.table("conversations").select("conv_id", "turn", tx.candidate_key(case, F.col("turn")).alias("key"))


@query(
    "failure_class",
    """SELECT event_id, CASE WHEN invalid THEN 'validation' WHEN lower(error) LIKE '%monthly_request_count%' THEN 'quota'
  WHEN http_status IS NOT NULL THEN 'http=' || http_status ELSE 'transport' END AS class
FROM attempt WHERE status = 'failed'""",
    ("attempt",),
)
def failure_class(v):
    return v.attempt.where("status = 'failed'").select(
        "event_id", tx.failure_class(F.col("error"), F.col("http_status"), F.col("invalid")).alias("class")
    )
