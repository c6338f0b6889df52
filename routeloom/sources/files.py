"""File sources: JSON lines, libraries, checkpoints, source trees, cached records, id lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from routeloom.operators import contracts, ordered
from routeloom.session import cut_lineage

# Which files of a source tree are read.
SOURCE_SUFFIXES = [
    ".html", ".htm", ".css", ".scss", ".sass", ".less", ".js", ".mjs",
    ".cjs", ".jsx", ".ts", ".tsx", ".vue", ".svelte", ".astro", ".glsl",
    ".vert", ".frag", ".wgsl",
]
IGNORED_DIRS = [".git", "node_modules", "dist", "build", ".next", ".nuxt", "coverage", "__pycache__"]
IGNORED_FILES = [
    "source_card.html", "codrops_card.html", "metadata.json", "curl_info.json",
    "headers.txt", "url.txt", "status.json",
]
ENTRY_FILES = ["index.html", "index.htm", "main.js", "app.js", "main.ts", "app.ts"]

SKILL = "struct<name:string,description:string>"
NODE = "struct<name:string,description:string,parent_names:array<string>,child_names:array<string>,direct_skill_names:array<string>>"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` in file order; large files stay split over tasks."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    return ordered.positions(raw, ["file"], ["_at", "_id"], "line_no").select("file", "line_no", "line")


def jsonl_source(spark: SparkSession, path: str, schema: str | T.StructType, required: list[str]) -> DataFrame:
    """Parsed JSON lines with line number, broken text and the first missing required field.

    Blank lines are skipped but counted.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    lines = text_lines(spark, path).where(contracts.nonblank(F.col("line")))
    parsed = lines.withColumn(
        "_row", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    rows = parsed.select("file", "line_no", "_row.*")
    missing = contracts.nonblank_fields({name: F.col(name).cast("string") for name in required})
    return rows.withColumn("missing", F.when(F.col("_corrupt").isNull(), missing))


def library_source(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Skills of a library (category-grouped, flat or bare list): first of each name.

    ``(ord, name, description, categories)``.  A file is one JSON document, or with
    ``lines`` one document per line, which lets a large library be split over tasks.
    """
    if lines:
        raw = text_lines(spark, path).select("file", "line_no", F.col("line").alias("body"))
    else:
        raw = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("file"), F.lit(1).alias("line_no"), F.col("value").alias("body")
        )
    grouped = F.from_json("body", f"struct<categories:array<struct<name:string,skills:array<{SKILL}>>>,skills:array<{SKILL}>>")
    bare = F.from_json("body", f"array<{SKILL}>")
    is_list = F.ltrim("body").startswith("[")
    in_groups = F.flatten(F.transform(grouped["categories"], lambda c: F.transform(c["skills"], lambda s: F.struct(s["name"].alias("name"), s["description"].alias("description"), c["name"].alias("category")))))
    plain = lambda a: F.transform(a, lambda s: F.struct(s["name"].alias("name"), s["description"].alias("description"), F.lit(None).cast("string").alias("category")))
    listed = F.when(is_list, plain(bare)).when(grouped["categories"].isNotNull(), in_groups).otherwise(plain(grouped["skills"]))
    rows = raw.select("file", "line_no", F.posexplode(listed).alias("at", "s")).select("file", "line_no", "at", F.trim("s.name").alias("name"), F.trim("s.description").alias("description"), F.col("s.category").alias("category"))
    checked = rows.withColumn(
        "name", F.when(contracts.nonblank(F.col("name")) & contracts.nonblank(F.col("description")), F.col("name")).otherwise(F.raise_error(F.lit("skill without name or description")))
    )
    cats = checked.groupBy("name").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    place = ["file", "line_no", "at"]
    first = ordered.first_row(checked.select("name", "description", *place), ["name"], place)
    return ordered.positions(first, [], place, "ord").join(cats, "name").select("ord", "name", "description", "categories")


def checkpoint_source(spark: SparkSession, graph_path: str, skills_path: str) -> dict[str, DataFrame]:
    """Node, edge, membership and skill tables of a ``graph.json`` + ``skills.jsonl`` checkpoint."""
    body = spark.read.text(graph_path, wholetext=True).select(
        F.from_json("value", f"struct<checkpoint:string,round:int,root_node_names:array<string>,nodes:map<string,{NODE}>>").alias("g")
    )
    roots = F.col("g.root_node_names")
    nodes = body.select(roots.alias("roots"), F.posexplode(F.map_entries("g.nodes")).alias("ord", "e"))
    node = nodes.select(
        F.col("e.key").alias("name"), F.coalesce("e.value.description", F.lit("")).alias("description"), "ord",
        F.array_contains("roots", F.col("e.key")).alias("is_root"),
    )
    edge = nodes.select(F.col("e.key").alias("parent"), F.posexplode("e.value.child_names").alias("pos", "child"))
    member = nodes.select(F.col("e.key").alias("node"), F.posexplode("e.value.direct_skill_names").alias("pos", "skill"))
    skill = jsonl_source(spark, skills_path, "name string, description string, canonical_document string, aliases array<string>, merged_into string", ["name"])
    return {
        "node": node, "edge": edge.select("parent", "child", "pos"), "member": member.select("node", "skill", "pos"),
        "skill": skill.select(F.col("name").alias("skill"), "description", F.col("canonical_document").alias("doc"), "aliases", "merged_into"),
    }


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "(\\.[^./]+)$", 1))


def source_tree_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of each site directory below ``root`` that are worth reading, by path and length alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_plain_path(root)).select("path", "length").where("length > 0")
    base = re.sub("^file:/*", "/", root).rstrip("/")
    below = F.substring("path", F.instr("path", base) + len(base) + 1, F.length("path"))
    parts = F.split(below, "/")
    name = F.element_at(parts, -1)
    dirs = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    keep = (
        suffix_of(name).isin(SOURCE_SUFFIXES) & ~F.lower(name).isin(IGNORED_FILES) & ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in IGNORED_DIRS]))
        & (F.size(parts) >= 2)
    )
    return files.where(keep).select(
        F.col("path").alias("address"), "length", F.element_at(parts, 1).alias("site"), F.array_join(F.slice(parts, 2, F.size(parts)), "/").alias("path"),
        suffix_of(name).alias("suffix"), F.when(F.lower(name).isin(ENTRY_FILES), 0).otherwise(1).alias("pref"), F.lower(name).isin("index.html", "index.htm").alias("is_index"),
    )


def source_tree_scan(spark: SparkSession, root: str) -> DataFrame:
    """Readable files of each site directory below ``root``: preferred entry files first, then by path.

    Files are chosen by path and length, then only those are opened: no byte of another file
    is read.  The chosen names pass through the driver, which lists the tree in any case.
    """
    kept = cut_lineage(source_tree_files(spark, root))
    names = [_plain_path(r["address"]) for r in kept.select("address").toLocalIterator()]
    if not names:
        return kept.select("site", "path", "suffix", "pref", "is_index", F.lit(None).cast("string").alias("text"))
    content = spark.read.format("binaryFile").load(names).select(F.col("path").alias("address"), F.decode("content", "UTF-8").alias("text"))
    return kept.join(content, "address").select("site", "path", "suffix", "pref", "is_index", "text")


def _plain_path(address: str) -> str:
    """An address as a path pattern that means that file alone."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", address)


def site_folders(sites: DataFrame) -> DataFrame:
    """Among folders sharing a number the longest name is kept; ids from the number."""
    number = F.regexp_extract("site", "^(\\d{4})[-_]", 1)
    named = sites.select("site").distinct().withColumn("number", F.nullif(number, F.lit("")).cast("int")).where("number IS NOT NULL")
    return named.groupBy("number").agg(F.max_by("site", F.struct(F.length("site"), "site")).alias("site"))


def sidecar_metadata(status_json: Column, url_text: Column) -> Column:
    """Two JSON sections, then ``key: value`` lines, merged to one map; later entries win.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` only inside the expression's own
    filter, so repeats are removed here and no session setting is required.
    """
    sections = F.from_json(status_json, "struct<project:map<string,string>,download:map<string,string>>")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    entries = F.concat(
        F.map_entries(F.coalesce(sections["project"], none)),
        F.map_entries(F.coalesce(sections["download"], none)),
        F.transform(
            F.filter(F.split(F.coalesce(url_text, F.lit("")), "\\r?\\n"), lambda l: l.contains(":")),
            lambda l: F.struct(F.trim(F.substring_index(l, ":", 1)).alias("key"), F.trim(F.regexp_replace(l, "^[^:]*:", "")).alias("value")),
        ),
    )
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def cached_record_scan(spark: SparkSession, pattern: str, schema: str, valid: Column, prefix: str) -> DataFrame:
    """Valid cached records with their case id (content first, else folder name); two per id are an error."""
    rows = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").json(pattern)
    folder = F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1)
    by_folder = F.when(folder.startswith(prefix), folder).when(folder.contains("_"), F.regexp_replace(folder, "^[^_]*_", "")).otherwise(folder)
    kept = rows.withColumn("_folder_id", by_folder).where(F.col("_corrupt").isNull() & F.coalesce(valid, F.lit(False)))
    kept = kept.withColumn("case_id", F.coalesce(F.nullif(F.trim("case_id"), F.lit("")), "_folder_id")).drop("_folder_id", "_corrupt")
    counts = kept.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    guarded = counts.withColumn(
        "_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(F.raise_error(F.concat(F.lit("two valid records for "), "case_id")).cast("long"))
    )
    return kept.join(guarded.where("_n = 1"), "case_id").drop("_n")


def id_list_source(spark: SparkSession, path: str, prefix: str, inline: str = "") -> DataFrame:
    """Ids of a list file (``#`` comments, first word of a line) and an inline list; numbers padded."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    words = lines.select(F.regexp_extract("v", "^(\\S+)", 1).alias("t"))
    if inline.strip():
        extra = spark.range(1).select(F.explode(F.split(F.lit(inline.strip()), "[\\s,]+")).alias("t")).where("t <> ''")
        words = words.unionByName(extra)
    # Longer numbers keep all their digits: lpad alone would cut them.
    number = F.col("t").cast("long").cast("string")
    padded = F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0"))
    return words.select(F.when(F.col("t").rlike("^\\d+$"), F.concat(F.lit(f"{prefix}-"), padded)).otherwise(F.col("t")).alias("case_id")).distinct()


def provenance_source(spark: SparkSession, path: str) -> DataFrame:
    """``map<case, array<struct>>`` to one row per (case, skill)."""
    item = "struct<skill:string,title:string,url:string,case_id:string>"
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,array<{item}>>").alias("m"))
    return body.select(F.explode("m").alias("case", "items")).select("case", F.posexplode("items").alias("pos", "i")).select("case", "pos", "i.*")
