"""Ordered contract checks: each reports whether a record holds and the first broken rule.

A contract is a list of ``(rule, holds)`` pairs in the order they are applied; a
condition that is null counts as broken.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from routeloom.functions import text as tx

Rules = Sequence[tuple[str, Column]]

# Field names, enumerations, the section titles and the exclusion marker.
SKILL_FIELDS = [
    "name", "description", "experience_scope", "content_and_composition", "experience_progression",
    "attention_and_information_flow", "interaction_model", "experience_qualities",
    "completion_and_return", "locked_observable_requirements", "adaptable_details",
    "portability_boundary",
]
INTERACTION_FIELDS = ["input", "affected_object", "state_change", "visible_feedback", "control_and_recovery"]
NONBLANK_FIELDS = ["description", "experience_scope", "portability_boundary"]
LIST_MINIMUM = {
    "content_and_composition": 1, "experience_progression": 0, "attention_and_information_flow": 1,
    "experience_qualities": 1, "completion_and_return": 1, "locked_observable_requirements": 1,
    "adaptable_details": 0,
}
REQUIRED_SECTIONS = [
    "## Use this skill when",
    "## Core mechanism",
    "## Implementation workflow",
    "## State and update model",
    "## Constraints and invariants",
    "## Adaptation points",
    "## Validation",
]
LEVELS = ["goal", "experience", "interaction"]
EXCLUSION_MARKER = "NO_ELIGIBLE_VISUAL_SKILL"


def first_broken(rules: Rules) -> Column:
    """Name of the first rule that does not hold, null where all hold."""
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules])


def check(df: DataFrame, rules: Rules) -> DataFrame:
    out = df.withColumn("rule", first_broken(rules))
    return out.withColumn("ok", F.col("rule").isNull())


def closed_keys(body: Column, allowed: Sequence[str]) -> Column:
    """The JSON object has exactly these keys."""
    keys = F.array_sort(F.json_object_keys(body))
    return F.coalesce(keys == F.array(*[F.lit(k) for k in sorted(allowed)]), F.lit(False))


def nonblank(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value, "\\s+", "") != "", F.lit(False))


def nonblank_fields(fields: dict[str, Column]) -> Column:
    """Name of the first blank field, null where all are filled."""
    return first_broken([(name, nonblank(value)) for name, value in fields.items()])


def all_nonblank(values: Column, minimum: int = 0) -> Column:
    return F.forall(values, lambda v: nonblank(v)) & (F.size(values) >= minimum)


def no_repeats(values: Column) -> Column:
    return F.size(values) == F.size(F.array_distinct(values))


def same_set(left: Column, right: Column) -> Column:
    return (F.size(F.array_except(left, right)) == 0) & (F.size(F.array_except(right, left)) == 0)


def raw_items(body: Column, field: str) -> Column:
    """A JSON list as the texts of its items."""
    return F.from_json(body, f"struct<{field}:array<string>>")[field]


def parsed_items(df: DataFrame, body: str, field: str, item: dict[str, str]) -> DataFrame:
    """Add ``_doc``, ``_keys`` and ``_items`` of a JSON reply, parsed once per row.

    An item becomes its sorted keys plus, per field, the text (``name``) and the type
    (``name_type``); ``item`` maps fields to the type their value is read as.
    """
    doc = F.try_parse_json(body)
    df = pin(df, {"_doc": doc})
    keys = F.array_sort(F.map_keys(F.try_variant_get("_doc", "$", "map<string,variant>")))
    raw = F.try_variant_get("_doc", f"$.{field}", "array<variant>")

    def unpack(v: Column) -> Column:
        cols = [F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))).alias("keys")]
        for name, kind in item.items():
            cols.append(F.try_variant_get(v, f"$.{name}", kind).alias(name))
            cols.append(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).alias(f"{name}_type"))
        return F.struct(*cols)

    return pin(df, {"_keys": keys, "_items": F.transform(raw, unpack)})


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns computed once per row: a generator is never inlined into later expressions."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


def _keys_are(keys: Column, allowed: Sequence[str]) -> Column:
    return keys == F.array(*[F.lit(k) for k in sorted(allowed)])


def _texts(field: str) -> Column:
    return F.transform("_items", lambda i: F.when(i[f"{field}_type"] == "STRING", tx.strip(i[field])))


def check_route_reply(df: DataFrame, body: str, supplied: str) -> DataFrame:
    """``{"ranking": [{name, reason, confidence}]}`` over the supplied node names."""
    fields = ["name", "reason", "confidence"]
    rows = parsed_items(df, body, "ranking", dict.fromkeys(fields, "string"))
    names = _texts("name")
    rules = [
        ("json", F.col("_doc").isNotNull()),
        ("keys", _keys_are(F.col("_keys"), ["ranking"])),
        ("list", F.col("_items").isNotNull()),
        ("item_keys", F.forall("_items", lambda i: F.coalesce(_keys_are(i["keys"], fields), F.lit(False)))),
        ("name", (F.size(F.array_except(names, supplied)) == 0) & no_repeats(names)),
        ("confidence", F.forall(_texts("confidence"), lambda c: F.coalesce(c.isin("high", "medium", "low"), F.lit(False)))),
        ("reason", F.forall(_texts("reason"), nonblank)),
    ]
    ranking = F.transform(
        names, lambda n, i: F.struct((i + 1).alias("rank"), n.alias("name"), F.col("_items")[i]["confidence"].alias("confidence"))
    )
    return check(rows, rules).withColumn("ranking", F.when(F.col("ok"), ranking)).drop("_doc", "_keys", "_items")


def check_review_reply(df: DataFrame, body: str, supplied: str) -> DataFrame:
    """``{"decisions": [{name, applicable, score, reason}]}``: every supplied skill once.

    A score has to be a JSON integer; a quoted number or a boolean is broken.
    """
    fields = {"name": "string", "applicable": "boolean", "score": "bigint", "reason": "string"}
    rows = parsed_items(df, body, "decisions", fields)
    rows = pin(rows, {"_names": _texts("name")})
    names = F.col("_names")
    rules = [
        ("json", F.col("_doc").isNotNull()),
        ("keys", _keys_are(F.col("_keys"), ["decisions"])),
        ("list", F.col("_items").isNotNull()),
        ("item_keys", F.forall("_items", lambda i: F.coalesce(_keys_are(i["keys"], list(fields)), F.lit(False)))),
        ("name", (F.size(F.array_except(names, supplied)) == 0) & no_repeats(names)),
        ("applicable", F.forall("_items", lambda i: i["applicable_type"] == "BOOLEAN")),
        ("score", F.forall("_items", lambda i: (i["score_type"] == "BIGINT") & i["score"].between(0, 100))),
        ("reason", F.forall(_texts("reason"), nonblank)),
        ("coverage", F.size(names) == F.size(supplied)),
    ]
    return check(rows, rules).drop("_doc", "_keys", "_items", "_names")


def segment_rules(levels: Column, texts: Column) -> Rules:
    return [
        ("count", F.size(levels) == len(LEVELS)),
        ("order", levels == F.array(*[F.lit(x) for x in LEVELS])),
        ("text", F.forall(texts, nonblank)),
    ]


def segment_sets(rows: DataFrame, key: str, pos: str, level: str, text: str) -> DataFrame:
    """First broken rule of each set of segments (``key, n, rule, ok``), sets of any size.

    Sets of the wrong size are told by their count alone, so only sets of three rows are
    ever put together.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    right = rows.join(sizes.where(F.col("n") == len(LEVELS)), key)
    packed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(level).alias("level"), F.col(text).alias("text"))))
    sets = right.groupBy(key, "n").agg(packed.alias("s"))
    judged = check(sets, segment_rules(F.transform("s", lambda x: x["level"]), F.transform("s", lambda x: x["text"])))
    wrong = sizes.where(F.col("n") != len(LEVELS)).select(key, "n", F.lit("count").alias("rule"), F.lit(False).alias("ok"))
    return judged.select(key, "n", "rule", "ok").unionByName(wrong)


def category_rules(name: Column, description: Column, strict: bool = False) -> Rules:
    """Snake-case name and a positive ``Fits`` statement (``strict``: the literal word)."""
    fits = description.contains("Fits ") if strict else description.rlike("(?i)\\bfits\\b")
    return [("name", nonblank(name)), ("description", nonblank(description)), ("snake_case", tx.is_snake(name)), ("fits", fits)]


def distillation_rules(summary: Column, categories: Column, skills: Column) -> Rules:
    """``categories``: names; ``skills``: struct(name, category_names)."""
    listed = F.transform(skills, lambda s: s["category_names"])
    names = F.transform(skills, lambda s: s["name"])
    used = F.array_distinct(F.flatten(listed))
    marked = F.trim(summary) == EXCLUSION_MARKER
    return [
        ("duplicate_category", no_repeats(categories)),
        ("category_reference", F.forall(listed, lambda c: (F.size(c) > 0) & no_repeats(c) & (F.size(F.array_except(c, categories)) == 0))),
        ("duplicate_skill", no_repeats(names)),
        ("unused_category", same_set(used, categories)),
        ("both_or_none", (F.size(categories) == 0) == (F.size(skills) == 0)),
        ("summary", nonblank(summary)),
        ("marker_missing", (F.size(categories) > 0) | marked),
        ("marker_extra", (F.size(categories) == 0) | ~marked),
    ]


def skill_record_rules(body: Column) -> Rules:
    """The twelve fields of a skill record."""
    items = raw_items(body, "interaction_model")
    get = lambda f: F.get_json_object(body, f"$.{f}")
    complete = lambda i: reduce(lambda a, b: a & b, [nonblank(F.get_json_object(i, f"$.{f}")) for f in INTERACTION_FIELDS])
    rules: list[tuple[str, Column]] = [
        ("json", F.try_parse_json(body).isNotNull()),
        ("keys", closed_keys(body, SKILL_FIELDS)),
        ("interaction_model", F.size(items) > 0),
        ("interaction_keys", F.forall(items, lambda i: closed_keys(i, INTERACTION_FIELDS))),
        ("interaction_text", F.forall(items, complete)),
        ("name", tx.is_snake(get("name"))),
    ]
    rules += [(f, nonblank(get(f))) for f in NONBLANK_FIELDS]
    rules += [(f, all_nonblank(raw_items(body, f), least)) for f, least in LIST_MINIMUM.items()]
    return rules


def document_rules(text: Column, name: Column, description: Column, tokens: Column) -> Rules:
    """Front matter, length, headings, sections in order, framework terms, identity tokens."""
    front = tx.front_matter(text)
    at = F.array(*[F.instr(front["body"], s) for s in REQUIRED_SECTIONS])
    lines = F.size(F.split(F.regexp_replace(text, "\n\\z", ""), "\n"))
    return [
        ("name", tx.is_kebab(name)),
        ("front_matter", front["ok"]),
        ("mismatch", (front["name"] == name) & (front["description"] == description)),
        ("length", lines <= 500),
        ("heading", front["body"].rlike("(?m)^# [^#\\n]+$")),
        ("sections", (F.array_min(at) > 0) & (at == F.array_sort(at))),
        ("framework", ~text.rlike(tx.FRAMEWORK_TERMS)),
        ("identity", ~F.exists(tokens, lambda t: (t != "") & F.contains(F.lower(text), F.lower(t)))),
    ]


def query_set_audit(rows: DataFrame, key: str, pos: str, text: str, expected: int, low: int = 3, high: int = 50) -> DataFrame:
    """Per query set: size and the first broken rule, in the order of the list.

    Repeats are found by the first position of each normalized text, so a set of any
    size is checked by aggregates only.
    """
    flat = rows.select(key, pos, tx.collapse_ws(F.col(text)).alias("_t"))
    flat = flat.select(key, pos, "_t", F.md5(tx.normalize_text(F.col("_t"))).alias("_n"), (tx.normalize_text(F.col("_t")) == "").alias("_blank"))
    first = flat.groupBy(key, "_n").agg(F.min(pos).alias("_first"))
    words = F.when(F.col("_t") == "", 0).otherwise(F.size(F.split("_t", " ")))
    rule = (
        F.when(~words.between(low, high), "word_count")
        .when(tx.has_cjk(F.col("_t")), "cjk")
        .when(F.col("_blank") | (F.col("_first") < F.col(pos)), "duplicate")
    )
    judged = flat.join(first, [key, "_n"]).select(key, pos, rule.alias("_rule"))
    per = judged.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("_rule", F.when(F.col("_rule").isNotNull(), F.col(pos))).alias("_bad")
    )
    return per.select(key, "n", F.when(F.col("n") != expected, "size").otherwise(F.col("_bad")).alias("rule")).withColumn("ok", F.col("rule").isNull())


def miss_stage_of(in_candidates: Column, rank: Column, k: int) -> Column:
    """Where the source was lost: at routing, in the ranking, or not at all."""
    return (
        F.when(~F.coalesce(in_candidates, F.lit(False)), "root_route")
        .when(rank.isNull() | (rank > k), "candidate_rank")
        .otherwise("none")
    )


def diagnosis_rules(k: int = 10) -> Rules:
    """Header rules over ``stage, operation, target, replacement, source, covered, source_rank, target_known``."""
    op, stage = F.col("operation"), F.col("stage")
    where = miss_stage_of(F.col("covered"), F.col("source_rank"), k)
    filled = nonblank(F.col("replacement"))
    node_op = op.isin("rewrite_node", "add_edge")
    return [
        ("stage", stage.isin("none", "root_route", "candidate_rank")),
        ("operation", op.isin("none", "rewrite_skill", "rewrite_node", "add_edge")),
        ("hit_repaired", (where != "none") | (op == "none")),
        ("hit_stage", (where != "none") | (stage == "none")),
        ("root_boundary", (where != "root_route") | ((stage == "root_route") & op.isin("none", "rewrite_node", "add_edge"))),
        ("skill_boundary", (where != "candidate_rank") | ((stage == "candidate_rank") & op.isin("none", "rewrite_skill"))),
        ("rewrite_skill", (op != "rewrite_skill") | ((F.col("target") == F.col("source")) & filled)),
        ("node_target", ~node_op | F.coalesce(F.col("target_known"), F.lit(False))),
        ("rewrite_node", (op != "rewrite_node") | filled),
        ("replacement", ~op.isin("none", "add_edge") | ~filled),
    ]


def relation_rules() -> Rules:
    """Item rules over ``a, b, relation, split_parent, distinction`` and known flags."""
    rel = F.col("relation")
    empty = (F.col("split_parent") == "") & (F.col("distinction") == "")
    return [
        ("endpoints", F.coalesce(F.col("a_known") & F.col("b_known"), F.lit(False)) & (F.col("a") != F.col("b"))),
        ("relation", rel.isin("same", "alternative_same_position")),
        ("same_fields", (rel != "same") | empty),
        ("alternative_fields", (rel != "alternative_same_position") | (F.coalesce(F.col("parent_known"), F.lit(False)) & nonblank(F.col("distinction")))),
    ]


def first_relations(rows: DataFrame) -> DataFrame:
    """Pairs sorted, repeats of a (pair, relation) in one request dropped keep-first."""
    from routeloom.operators import ordered

    x, y = tx.sorted_pair(F.col("a"), F.col("b"))
    return ordered.first_row(rows.withColumns({"a": x, "b": y}), ["query_id", "a", "b", "relation"], ["pos"])


def check_assignments(answers: DataFrame, supplied: DataFrame, children: DataFrame) -> DataFrame:
    """First broken rule of each (parent, skill) that was supplied or answered.

    ``answers``: parent, skill, children (array), keep; ``supplied``: parent, skill;
    ``children``: parent, child.  ``missing`` is a supplied skill without an answer,
    ``supplied`` an answer that nobody asked for.  Answered children are rows when they are
    compared with the parent's, so a parent may have any number of them.
    """
    key = ["parent", "skill"]
    per = answers.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("children", "keep")).alias("a"))
    per = per.select(*key, "times", F.coalesce("a.children", F.array().cast("array<string>")).alias("children"), F.coalesce("a.keep", F.lit(False)).alias("keep"))
    asked = supplied.select(*key).distinct().withColumn("_asked", F.lit(True))
    named = per.select(*key, F.explode("children").alias("child")).join(children.select("parent", "child").distinct(), ["parent", "child"], "left_anti")
    strange = named.select(*key, F.lit(True).alias("_strange")).distinct()
    rows = asked.join(per, key, "full_outer").join(strange, key, "left")
    n = F.size("children")
    rules = [
        ("missing", F.col("times").isNotNull()),
        ("supplied", F.col("_asked")),
        ("once", F.col("times") == 1),
        ("children", (n <= 2) & no_repeats(F.col("children")) & F.col("_strange").isNull()),
        ("exclusive", (n > 0) != F.col("keep")),
    ]
    return check(rows, rules).select(*key, "rule", "ok")


def merge_verdict_rules(equivalent: Column, keep: Column, a: Column, b: Column) -> Rules:
    return [
        ("keep_in_pair", ~equivalent | (keep == a) | (keep == b)),
        ("keep_empty", equivalent | (keep == "")),
    ]


# Fields of a decision, of a route and of a category, and the two operations.
DECISION_FIELDS = ["routes", "new_category", "rationale"]
ROUTE_FIELDS = ["operation", "category_name", "revised_category"]
CATEGORY_FIELDS = ["name", "description"]
ROUTE_OPERATIONS = ["select", "revise"]


def check_decisions(decisions: DataFrame, step: str, body: str) -> DataFrame:
    """``step, rule, ok``: first broken rule of each logged decision, in reading order.

    A decision is a JSON object of any number of routes, an optional new category and a
    rationale.  A category is known from the step after the one that created it; no step
    holds the whole catalog, births are joined.
    """
    void = lambda v: v.isNull() | (F.schema_of_variant(v) == "VOID")
    keys = lambda v, allowed: F.coalesce(_keys_are(F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))), allowed), F.lit(False))
    text = lambda v, f: F.try_variant_get(v, f"$.{f}", "string")

    def document(v: Column) -> Column:
        description = text(v, "description")
        return F.coalesce(keys(v, CATEGORY_FIELDS) & tx.is_snake(text(v, "name")) & description.contains("Fits "), F.lit(False))

    docs = pin(decisions.select(F.col(step).alias("step"), F.col(body).alias("_body")), {"doc": F.try_parse_json("_body")}).drop("_body")
    new = F.try_variant_get("doc", "$.new_category", "variant")
    docs = pin(docs, {"new": new, "routes": F.try_variant_get("doc", "$.routes", "array<variant>"), "rationale": text(F.col("doc"), "rationale")})
    born = docs.where(~void(F.col("new"))).groupBy(text(F.col("new"), "name").alias("name")).agg(F.min("step").alias("born"))

    routes = docs.select("step", F.posexplode("routes").alias("at", "r"))
    routes = pin(routes, {"name": text(F.col("r"), "category_name"), "op": text(F.col("r"), "operation"), "revised": F.try_variant_get("r", "$.revised_category", "variant")})
    first = routes.groupBy("step", "name").agg(F.min("at").alias("first"))
    routes = routes.join(born, "name", "left").join(first, ["step", "name"], "left")
    select, revise = F.col("op") == "select", F.col("op") == "revise"
    rule = first_broken([
        ("route_keys", keys(F.col("r"), ROUTE_FIELDS)),
        ("operation", F.col("op").isin(*ROUTE_OPERATIONS)),
        ("name", nonblank(F.col("name"))),
        ("known", F.col("born") < F.col("step")),
        ("once", F.col("first") == F.col("at")),
        ("select_empty", ~select | void(F.col("revised"))),
        ("revised", ~revise | document(F.col("revised"))),
        ("rename", ~revise | (text(F.col("revised"), "name") == F.col("name"))),
    ])
    worst = routes.withColumn("rule", rule).where("rule IS NOT NULL").groupBy("step").agg(F.min(F.struct("at", "rule")).alias("w"))
    taken = born.select(F.col("name").alias("new_name"), F.col("born").alias("new_born"))
    whole = docs.withColumn("new_name", text(F.col("new"), "name")).join(taken, "new_name", "left").join(worst, "step", "left")
    rules = [
        ("json", F.col("doc").isNotNull()),
        ("keys", keys(F.col("doc"), DECISION_FIELDS)),
        ("rationale", nonblank(F.col("rationale"))),
        ("routes", F.col("routes").isNotNull()),
        ("*", F.col("w").isNull()),
        ("new_category", void(F.col("new")) | document(F.col("new"))),
        ("new_taken", void(F.col("new")) | (F.col("new_born") == F.col("step"))),
        ("no_membership", (F.size("routes") > 0) | ~void(F.col("new"))),
    ]
    judged = whole.withColumn("rule", first_broken(rules))
    told = F.when(F.col("rule") == "*", F.col("w.rule")).otherwise(F.col("rule"))
    return judged.select(F.col("step").alias(step), told.alias("rule"), told.isNull().alias("ok"))


# Fields of a manifest, of its entries and of their evidence.
MANIFEST_FIELDS = ["decomposition_rationale", "skills"]
ENTRY_FIELDS = ["name", "description", "relative_path", "skill_contribution", "mechanism_scope", "source_evidence"]
EVIDENCE_FIELDS = ["path", "evidence"]


def manifest_rules(body: Column) -> Rules:
    """A manifest of written skills: keys, unique names, paths, contributions and their evidence."""
    entries = raw_items(body, "skills")
    get = lambda i, f: F.get_json_object(i, f"$.{f}")
    names = F.transform(entries, lambda i: get(i, "name"))
    proofs = lambda i: raw_items(i, "source_evidence")
    every = lambda rule: F.forall(entries, rule)
    return [
        ("json", F.try_parse_json(body).isNotNull()),
        ("keys", closed_keys(body, MANIFEST_FIELDS)),
        ("rationale", nonblank(F.get_json_object(body, "$.decomposition_rationale"))),
        ("skills", F.size(entries) > 0),
        ("item_keys", every(lambda i: closed_keys(i, ENTRY_FIELDS))),
        ("name", every(lambda i: F.coalesce(tx.is_kebab(get(i, "name")), F.lit(False)))),
        ("unique", no_repeats(names)),
        ("description", every(lambda i: nonblank(get(i, "description")))),
        ("path", every(lambda i: F.coalesce(get(i, "relative_path") == F.concat(F.lit("skills/"), get(i, "name"), F.lit("/SKILL.md")), F.lit(False)))),
        ("scope", every(lambda i: F.coalesce(all_nonblank(raw_items(i, "mechanism_scope"), 1), F.lit(False)))),
        ("contribution", every(lambda i: nonblank(get(i, "skill_contribution")))),
        ("evidence", every(lambda i: F.coalesce(F.size(proofs(i)) > 0, F.lit(False)))),
        ("evidence_keys", every(lambda i: F.forall(proofs(i), lambda e: closed_keys(e, EVIDENCE_FIELDS)))),
        ("evidence_text", every(lambda i: F.forall(proofs(i), lambda e: nonblank(get(e, "path")) & nonblank(get(e, "evidence"))))),
    ]


def exact_cover(supplied: DataFrame, answered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows supplied but not answered, answered but not supplied, or answered more than once."""
    a = supplied.select(*keys).distinct().withColumn("_s", F.lit(True))
    b = answered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    both = a.join(b, list(keys), "full_outer")
    kind = F.when(F.col("_n").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(F.col("_n") > 1, "repeated")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "kind")
