"""Views that shape the driver tables like the engine's inputs, in Spark and in SQL.

Every view is a projection or join of whole tables.  The SQL text of a view is
only used by the correctness oracles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from routeloom.operators import ordered
from routeloom.session import cut_lineage

#: Candidates of a diagnosis batch: a fixed value.
DIAGNOSED = 10


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- routing graph -------------------------------------------------------
    @cached_property
    def part_dag(self) -> DataFrame:
        """One row per part with the names of the nodes above it."""
        bn = F.regexp_extract("p_brand", "([0-9]+)", 1)
        tn = F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", "_")
        size = F.col("p_size").cast("string")
        return self.table("part").select(
            "p_partkey",
            F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("skill"),
            "p_name",
            "p_type",
            "p_brand",
            "p_size",
            "p_retailprice",
            bn.alias("bn"),
            tn.alias("tn"),
            F.concat(F.lit("brand_"), bn).alias("brand"),
            F.concat(F.lit("type_"), tn).alias("typ"),
            F.concat_ws("_", F.lit("mid"), bn, tn).alias("mid"),
            F.concat_ws("_", F.lit("leaf"), bn, tn, size).alias("leaf"),
        )

    @cached_property
    def node(self) -> DataFrame:
        cells = self.part_dag.select("bn", "tn", "p_size", "brand", "typ", "mid", "leaf").distinct()
        card = lambda name, text, root: F.struct(
            name.alias("name"), text.alias("description"), F.lit(root).alias("is_root")
        )
        bn, tn, size = F.col("bn"), F.col("tn"), F.col("p_size").cast("string")
        return (
            cells.select(
                F.inline(
                    F.array(
                        card(F.col("brand"), F.concat(F.lit("Fits brand b"), bn), True),
                        card(F.col("typ"), F.concat(F.lit("Fits type "), tn), True),
                        card(F.col("mid"), F.concat(F.lit("Fits type "), tn, F.lit(" brand b"), bn), False),
                        card(
                            F.col("leaf"),
                            F.concat(F.lit("Fits size s"), size, F.lit(" type "), tn, F.lit(" brand b"), bn),
                            False,
                        ),
                    )
                )
            )
        ).distinct()

    @cached_property
    def edge(self) -> DataFrame:
        cells = self.part_dag.select("p_size", "brand", "typ", "mid", "leaf").distinct()
        pair = lambda p, c: F.struct(F.col(p).alias("parent"), F.col(c).alias("child"))
        return (
            cells.select(
                F.inline(
                    F.array_compact(
                        F.array(
                            pair("brand", "mid"),
                            pair("typ", "mid"),
                            pair("mid", "leaf"),
                            F.when(F.col("p_size") >= 46, pair("typ", "leaf")),
                        )
                    )
                )
            )
        ).distinct()

    @cached_property
    def member(self) -> DataFrame:
        """Direct membership; wide parts also sit higher up (multi-parent)."""
        put = lambda n: F.struct(F.col(n).alias("node"), F.col("skill").alias("skill"), F.col("p_partkey").alias("pos"))
        return self.part_dag.select(
            F.inline(
                F.array_compact(
                    F.array(
                        put("leaf"),
                        F.when(F.col("p_size") <= 40, put("mid")),
                        F.when(F.col("p_size") == 50, put("brand")),
                        F.when(F.col("p_size") == 49, put("typ")),
                    )
                )
            )
        )

    @cached_property
    def skill(self) -> DataFrame:
        """Skills; small parts are merged into the part numbered one lower."""
        merged = F.when(
            (F.col("p_size") <= 5) & (F.col("p_partkey") > 0),
            F.concat(F.lit("part_"), (F.col("p_partkey") - 1).cast("string")),
        )
        return self.part_dag.select(
            "skill", "p_partkey", F.col("p_name").alias("description"), merged.alias("merged_into")
        )

    @cached_property
    def route_query(self) -> DataFrame:
        """One request per part, written in the words of its place in the graph."""
        return self.part_dag.select(
            F.col("p_partkey").alias("query_id"),
            F.col("skill").alias("source"),
            F.concat(
                F.lit("brand b"), "bn", F.lit(" type "), "tn", F.lit(" size s"),
                F.col("p_size").cast("string"), F.lit(" "), "p_name",
            ).alias("query"),
        )

    # -- ranked requests -----------------------------------------------------
    @cached_property
    def line(self) -> DataFrame:
        """One row per (order, part): order lines repeat a line number and hold -0.0."""
        return (
            self.table("lineitem")
            .groupBy("l_orderkey", "l_partkey")
            .agg(
                F.min("l_linenumber").alias("ln"),
                F.abs(F.max("l_discount")).alias("disc"),
                F.min("l_returnflag").alias("flag"),
                F.min("l_linestatus").alias("st"),
            )
            .select(
                "l_orderkey",
                "l_partkey",
                F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("skill"),
                "ln",
                F.round(F.col("disc") * 1000).cast("int").alias("score"),
                (F.col("flag") != "R").alias("applicable"),
                "flag",
                "st",
            )
        )

    @cached_property
    def stored_line(self) -> DataFrame:
        """The lines as one table of numbers; names are made from them where they are read."""
        return cut_lineage(self.line.drop("skill"))

    def _named(self, lines: DataFrame) -> DataFrame:
        return lines.withColumn("skill", F.concat(F.lit("part_"), F.col("l_partkey").cast("string")))

    @cached_property
    def first_line(self) -> DataFrame:
        """The first candidate of each request."""
        rows = self.stored_line.select("l_orderkey", "ln", "l_partkey", "flag")
        return self._named(cut_lineage(ordered.first_row(rows, ["l_orderkey"], ["ln", "l_partkey"])))

    @cached_property
    def batch(self) -> DataFrame:
        """All candidates of each request in the order of their review."""
        # Read by several branches of a query: one table, and one scan of the lines for it.
        placed = cut_lineage(ordered.positions(self.stored_line, ["l_orderkey"], ["ln", "l_partkey"], "pos"))
        return self._named(placed)

    @cached_property
    def batch_part(self) -> DataFrame:
        parts = self.part_dag.select(
            "p_partkey", "p_type", "brand", "typ", "mid", "leaf", "p_size", F.col("p_name").alias("doc")
        )
        return self.batch.join(parts, self.batch.l_partkey == parts.p_partkey)

    @cached_property
    def diagnosis(self) -> DataFrame:
        """Header per request: the source is the first candidate, the repair follows its flag."""
        parts = self.part_dag.select("p_partkey", "brand")
        first = self.first_line.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        op = F.when(F.col("flag") == "R", "add_edge").when(F.col("flag") == "A", "rewrite_skill").otherwise("none")
        return first.select(
            F.col("l_orderkey").alias("query_id"),
            F.col("skill").alias("source"),
            op.alias("operation"),
            F.when(op == "add_edge", F.col("brand")).when(op == "rewrite_skill", F.col("skill")).otherwise("").alias("target"),
            F.when(op == "rewrite_skill", F.concat(F.lit("new "), "skill")).otherwise("").alias("replacement"),
        )

    @cached_property
    def relation(self) -> DataFrame:
        """All pairs of the ten best scored candidates of a request, its diagnosis batch."""
        parts = self.part_dag.select("p_partkey", "p_type", "bn", "p_size")
        lines = self.stored_line.where("l_orderkey IS NOT NULL").select("l_orderkey", "l_partkey", "ln", "score")
        met = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
        best = ordered.top_k(met, ["l_orderkey"], [F.desc("score"), "ln", "l_partkey"], DIAGNOSED, "place")
        name = lambda c: F.concat(F.lit("part_"), c.cast("string"))
        # a request has ten rows at most
        item = F.struct("l_partkey", "p_type", "bn", "p_size", name(F.col("l_partkey")).alias("skill"))
        pair = lambda x, y: F.struct(
            x["l_partkey"].alias("a"), y["l_partkey"].alias("b"), x["p_type"].alias("x_type"), y["p_type"].alias("y_type"), x["bn"].alias("bn"), x["p_size"].alias("p_size")
        )
        pairs = F.flatten(
            F.transform("items", lambda x: F.transform(F.filter("items", lambda y: x["skill"] < y["skill"]), lambda y: pair(x, y)))
        )
        sources = self.first_line.select("l_orderkey", F.col("l_partkey").alias("source"))
        # Several branches of a plan read the relations: one table of numbers and types, whose
        # names and texts are made where they are read.
        rows = cut_lineage(
            best.groupBy("l_orderkey").agg(F.collect_list(item).alias("items")).join(sources, "l_orderkey")
            .select(F.col("l_orderkey").alias("query_id"), "source", F.inline(pairs))
        )
        same = F.col("x_type") == F.col("y_type")
        tn = F.regexp_replace(F.lower("x_type"), "[^a-z0-9]+", "_")
        return rows.select(
            "query_id",
            name(F.col("source")).alias("source"),
            name(F.col("a")).alias("a"),
            name(F.col("b")).alias("b"),
            F.when(same, "same").otherwise("alternative_same_position").alias("relation"),
            F.concat(F.lit("r_"), F.col("query_id").cast("string")).alias("reason"),
            F.when(same, "").when(F.col("p_size") <= 25, F.concat(F.lit("type_"), tn)).otherwise(F.concat(F.lit("brand_"), "bn")).alias("split_parent"),
            F.when(same, "").otherwise(F.concat("x_type", F.lit("/"), "y_type")).alias("distinction"),
        )

    # -- vectors ---------------------------------------------------------------
    @cached_property
    def vector(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
        )

    # -- texts -------------------------------------------------------------------
    @cached_property
    def term_doc(self) -> DataFrame:
        """Documents with technology names added (the raw texts hold none)."""
        extra = (
            F.when(F.col("doc_id") % 7 == 0, " uses WebGL")
            .when(F.col("doc_id") % 7 == 1, " React app")
            .when(F.col("doc_id") % 7 == 2, " svg and GSAP")
            .otherwise("")
        )
        return self.table("documents").withColumn("text", F.concat("text", extra))

    @cached_property
    def page_source(self) -> DataFrame:
        """Page sources; some carry an embedded base64 image."""
        blob = F.concat(
            F.lit("<img src='data:image/png;base64,"), F.expr("repeat('QUJD', 80)"), F.lit("'>")
        )
        html = F.when(F.col("page_id") % 5 == 0, F.concat("html", blob)).otherwise(F.col("html"))
        return self.table("pages").select("page_id", "url", html.alias("html"))

    # -- resumed runs --------------------------------------------------------------
    @cached_property
    def done(self) -> DataFrame:
        """Finished records: the stored input was altered where quality is 0, reviewed where not toxic."""
        labels = self.table("labels")
        docs = self.table("documents").select("doc_id", F.md5("text").alias("digest"))
        stored = F.when(F.col("quality") == 0, F.concat(F.lit("old "), "digest")).otherwise(F.col("digest"))
        return docs.join(labels, "doc_id").select(
            "doc_id",
            stored.alias("stored_digest"),
            F.when(F.col("quality") == 0, "v0").otherwise("v1").alias("version"),
            (F.col("toxic") == 0).alias("has_review"),
        )

    @cached_property
    def wanted(self) -> DataFrame:
        return self.table("documents").select("doc_id", "source", "lang", F.md5("text").alias("digest"))

    # -- request log ----------------------------------------------------------------
    @cached_property
    def attempt(self) -> DataFrame:
        failed = F.col("event_type") == "error"
        return self.table("events").select(
            "event_id",
            "ts",
            F.floor(F.col("event_id") / 3).alias("call_id"),
            (F.col("event_id") % 3 + 1).alias("attempt"),
            F.concat(F.lit("route_"), (F.col("user_id") % 4).cast("string")).alias("route"),
            F.when(F.col("event_type").isin("click", "view"), "route")
            .when(F.col("event_type") == "signup", "review")
            .otherwise("diagnose")
            .alias("phase"),
            F.when(failed, "failed").otherwise("accepted").alias("status"),
            F.col("value").alias("latency"),
            F.get_json_object("props", "$.k").cast("long").alias("tokens"),
            F.when(failed & (F.col("user_id") % 3 == 0), "Monthly_Request_Count exceeded")
            .when(failed & (F.col("user_id") % 3 == 1), "server error")
            .when(failed, "reset by peer")
            .alias("error"),
            F.when(failed & (F.col("user_id") % 3 == 1), 503).alias("http_status"),
            (failed & (F.col("value") < 5)).alias("invalid"),
        )

    @cached_property
    def decision(self) -> DataFrame:
        """Decision log: one step per event, ordered by time."""
        ev = self.table("events").select(
            "ts",
            "event_id",
            F.concat(F.lit("cat_"), (F.col("user_id") % 30).cast("string")).alias("category"),
            F.when(F.col("event_type") == "signup", "revise").otherwise("select").alias("op"),
            F.concat(F.lit("Fits d"), F.col("event_id").cast("string")).alias("description"),
            F.concat(F.lit("skill_"), (F.col("event_id") % 500).cast("string")).alias("skill"),
        )
        return ordered.positions(ev, [], ["ts", "event_id"], "step")


_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "part_dag": (
        (),
        """SELECT p_partkey, 'part_' || p_partkey AS skill, p_name, p_type, p_brand, p_size, p_retailprice, bn, tn,
  'brand_' || bn AS brand, 'type_' || tn AS typ, 'mid_' || bn || '_' || tn AS mid,
  'leaf_' || bn || '_' || tn || '_' || p_size AS leaf
FROM (SELECT *, regexp_extract(p_brand, '([0-9]+)', 1) AS bn,
  regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') AS tn FROM part)""",
    ),
    "node": (
        ("part_dag",),
        """SELECT DISTINCT brand AS name, 'Fits brand b' || bn AS description, true AS is_root FROM part_dag
UNION SELECT typ, 'Fits type ' || tn, true FROM part_dag
UNION SELECT mid, 'Fits type ' || tn || ' brand b' || bn, false FROM part_dag
UNION SELECT leaf, 'Fits size s' || p_size || ' type ' || tn || ' brand b' || bn, false FROM part_dag""",
    ),
    "edge": (
        ("part_dag",),
        """SELECT DISTINCT brand AS parent, mid AS child FROM part_dag UNION SELECT typ, mid FROM part_dag
UNION SELECT mid, leaf FROM part_dag UNION SELECT typ, leaf FROM part_dag WHERE p_size >= 46""",
    ),
    "member": (
        ("part_dag",),
        """SELECT leaf AS node, skill, p_partkey AS pos FROM part_dag
UNION ALL SELECT mid, skill, p_partkey FROM part_dag WHERE p_size <= 40
UNION ALL SELECT brand, skill, p_partkey FROM part_dag WHERE p_size = 50
UNION ALL SELECT typ, skill, p_partkey FROM part_dag WHERE p_size = 49""",
    ),
    "skill": (
        ("part_dag",),
        """SELECT skill, p_partkey, p_name AS description,
  CASE WHEN p_size <= 5 AND p_partkey > 0 THEN 'part_' || (p_partkey - 1) END AS merged_into FROM part_dag""",
    ),
    "canonical": (
        ("skill",),
        """SELECT name, last(step_name ORDER BY d) AS canonical FROM (
  WITH RECURSIVE walk(name, step_name, d) AS (
    SELECT skill, skill, 0 FROM skill
    UNION ALL SELECT w.name, s.merged_into, d + 1 FROM walk w JOIN skill s ON s.skill = w.step_name
    WHERE s.merged_into IS NOT NULL)
  SELECT * FROM walk) GROUP BY name""",
    ),
    "depth": (
        ("node", "edge"),
        """SELECT name, max(d) AS depth FROM (
  WITH RECURSIVE walk(name, d) AS (
    SELECT name, 0 FROM node WHERE is_root
    UNION SELECT e.child, d + 1 FROM walk w JOIN edge e ON e.parent = w.name)
  SELECT * FROM walk) GROUP BY name""",
    ),
    "route_query": (
        ("part_dag",),
        """SELECT p_partkey AS query_id, skill AS source,
  'brand b' || bn || ' type ' || tn || ' size s' || p_size || ' ' || p_name AS query FROM part_dag""",
    ),
    "line": (
        (),
        """SELECT l_orderkey, l_partkey, 'part_' || l_partkey AS skill, ln,
  CAST(round(disc * 1000) AS INTEGER) AS score, flag <> 'R' AS applicable, flag, st
FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS ln, abs(max(l_discount)) AS disc,
  min(l_returnflag) AS flag, min(l_linestatus) AS st FROM lineitem GROUP BY 1, 2)""",
    ),
    "batch": (
        ("line",),
        """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ln, l_partkey) AS pos FROM line""",
    ),
    "batch_part": (
        ("batch", "part_dag"),
        """SELECT b.*, p.p_type, p.brand, p.typ, p.mid, p.leaf, p.p_size, p.p_name AS doc
FROM batch b JOIN part_dag p ON p.p_partkey = b.l_partkey""",
    ),
    "diagnosis": (
        ("batch_part",),
        """SELECT query_id, source, operation,
  CASE operation WHEN 'add_edge' THEN brand WHEN 'rewrite_skill' THEN source ELSE '' END AS target,
  CASE operation WHEN 'rewrite_skill' THEN 'new ' || source ELSE '' END AS replacement
FROM (SELECT l_orderkey AS query_id, skill AS source, brand,
  CASE flag WHEN 'R' THEN 'add_edge' WHEN 'A' THEN 'rewrite_skill' ELSE 'none' END AS operation
  FROM batch_part WHERE pos = 1)""",
    ),
    "best_part": (
        ("batch_part",),
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, ln, l_partkey) AS place
FROM batch_part) WHERE place <= 10""",
    ),
    "relation": (
        ("batch_part", "best_part"),
        """SELECT x.l_orderkey AS query_id, s.skill AS source, x.skill AS a, y.skill AS b,
  CASE WHEN x.p_type = y.p_type THEN 'same' ELSE 'alternative_same_position' END AS relation,
  'r_' || x.l_orderkey AS reason,
  CASE WHEN x.p_type = y.p_type THEN '' WHEN x.p_size <= 25 THEN x.typ ELSE x.brand END AS split_parent,
  CASE WHEN x.p_type = y.p_type THEN '' ELSE x.p_type || '/' || y.p_type END AS distinction
FROM best_part x JOIN best_part y ON x.l_orderkey = y.l_orderkey AND x.skill < y.skill
JOIN batch_part s ON s.l_orderkey = x.l_orderkey AND s.pos = 1""",
    ),
    "vector": (
        (),
        "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    ),
    "mean": (
        ("vector",),
        """SELECT label AS mean_label, list(x ORDER BY i) AS m FROM (
  SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM vector)
  GROUP BY label, i) GROUP BY label""",
    ),
    "term_doc": (
        (),
        """SELECT doc_id, lang, source, text || CASE doc_id % 7 WHEN 0 THEN ' uses WebGL' WHEN 1 THEN ' React app'
  WHEN 2 THEN ' svg and GSAP' ELSE '' END AS text FROM documents""",
    ),
    "page_source": (
        (),
        """SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN
  html || '<img src=''data:image/png;base64,' || repeat('QUJD', 80) || '''>' ELSE html END AS html FROM pages""",
    ),
    "wanted": ((), "SELECT doc_id, source, lang, md5(text) AS digest FROM documents"),
    "done": (
        ("wanted",),
        """SELECT w.doc_id, CASE WHEN quality = 0 THEN 'old ' || digest ELSE digest END AS stored_digest,
  CASE WHEN quality = 0 THEN 'v0' ELSE 'v1' END AS version, toxic = 0 AS has_review
FROM wanted w JOIN labels USING (doc_id)""",
    ),
    "attempt": (
        (),
        """SELECT event_id, ts, event_id // 3 AS call_id, event_id % 3 + 1 AS attempt, 'route_' || (user_id % 4) AS route,
  CASE WHEN event_type IN ('click', 'view') THEN 'route' WHEN event_type = 'signup' THEN 'review'
    ELSE 'diagnose' END AS phase,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'accepted' END AS status, value AS latency,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
  CASE WHEN event_type <> 'error' THEN NULL WHEN user_id % 3 = 0 THEN 'Monthly_Request_Count exceeded'
    WHEN user_id % 3 = 1 THEN 'server error' ELSE 'reset by peer' END AS error,
  CASE WHEN event_type = 'error' AND user_id % 3 = 1 THEN 503 END AS http_status,
  event_type = 'error' AND value < 5 AS invalid FROM events""",
    ),
    "decision": (
        (),
        """SELECT row_number() OVER (ORDER BY ts, event_id) AS step, 'cat_' || (user_id % 30) AS category,
  CASE WHEN event_type = 'signup' THEN 'revise' ELSE 'select' END AS op, 'Fits d' || event_id AS description,
  'skill_' || (event_id % 500) AS skill FROM events""",
    ),
}


def with_views(sql: str, uses: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the views it uses, in dependency order."""
    needed: list[str] = []

    def visit(name: str) -> None:
        deps, _ = _SQL[name]
        for dep in deps:
            visit(dep)
        if name not in needed:
            needed.append(name)

    for name in uses:
        visit(name)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({_SQL[n][1]})" for n in needed)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
