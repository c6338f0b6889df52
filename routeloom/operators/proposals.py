"""Structural proposals: their contract at item and proposal level, and their application in node order.

A proposal is one JSON reply per parent node.  Its items become rows; a rule that is broken
by an item either drops the item or rejects the whole proposal, and of all broken rules the
first in reading order names the verdict.  Evidence is never packed: every cited request id
is a row that is joined with the rows it may cite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from routeloom.functions import text as tx
from routeloom.operators import contracts as ct, ordered, patches
from routeloom.operators.evidence import ALTERNATIVE
from routeloom.session import cut_lineage

# Field names of a proposal and of its items, and their order.
ITEM_FIELDS = {
    "skill_rewrites": ["skill_name", "replacement_description", "evidence_query_ids"],
    "add_edges": ["skill_name", "target_node", "evidence_query_ids"],
    "merges": ["keep_skill", "remove_skill", "evidence_query_ids"],
    "splits": ["parent_node", "children", "evidence_query_ids"],
}
REWRITE_FIELDS = ["replacement_description", "evidence_query_ids"]
CHILD_FIELDS = ["name", "description", "move_skill_names"]
SECTIONS = {"skill_rewrites": 2, "add_edges": 3, "merges": 4, "splits": 5}
SHAPE, NODE_TEXT, REQUIRED, NODE_IDS = 0, 1, 6, 7
OPERATIONS = {2: "rewrite_skill", 3: "add_edge", 4: "merge", 5: "split", 7: "rewrite_node"}
#: Place of each section when a proposal is applied.
APPLIED = {7: 0, 2: 1, 3: 2, 4: 3, 5: 4}
FEWEST_MOVED = 4
ITEM = ["parent", "section", "item"]


def _keys(value: Column, allowed: list[str]) -> Column:
    found = F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
    return F.coalesce(found == F.array(*[F.lit(k) for k in sorted(allowed)]), F.lit(False))


def _strings(value: Column, field: str) -> Column:
    """A list of texts or whole numbers as texts; null for anything else."""
    return F.try_variant_get(value, f"$.{field}", "array<string>")


def items(proposals: DataFrame) -> DataFrame:
    """One row per item (``parent, section, item, doc, shaped, ids`` and the fields it names).

    ``proposals``: parent, doc (variant).  A section that is not a list is item -1; the
    rewrite of the parent is the only item of its section, if it is not null.
    """
    one = []
    for name, section in SECTIONS.items():
        raw = F.try_variant_get("doc", f"$.{name}", "array<variant>")
        listed = F.coalesce(raw, F.array(F.lit(None).cast("variant")))
        at = F.when(raw.isNull(), F.lit(-1)).otherwise(F.col("pos")).alias("item")
        rows = proposals.select("parent", "doc", F.posexplode(listed).alias("pos", "it")).select(
            "parent", F.lit(section).alias("section"), at, F.col("it").alias("doc"), _keys(F.col("it"), ITEM_FIELDS[name]).alias("shaped")
        )
        one.append(rows)
    node = F.try_variant_get("doc", "$.parent_rewrite", "variant")
    given = node.isNotNull() & (F.schema_of_variant(node) != "VOID")
    one.append(
        proposals.where(given).select("parent", F.lit(NODE_IDS).alias("section"), F.lit(0).alias("item"), node.alias("doc"), _keys(node, REWRITE_FIELDS).alias("shaped"))
    )
    rows = one[0]
    for other in one[1:]:
        rows = rows.unionByName(other)
    text = lambda f: F.try_variant_get("doc", f"$.{f}", "string")
    return rows.select(
        *ITEM, "doc", "shaped", F.array_distinct(_strings(F.col("doc"), "evidence_query_ids")).alias("ids"),
        text("skill_name").alias("skill"), text("target_node").alias("target"), text("replacement_description").alias("text"),
        text("keep_skill").alias("keep"), text("remove_skill").alias("remove"), text("parent_node").alias("node"),
    )


def citable(relations: DataFrame, rows: DataFrame, misses: DataFrame) -> DataFrame:
    """``parent, section, about, query_id``: the requests that an item about something may cite.

    Section -1 holds everything supplied for the parent.
    """
    shown = rows.join(relations.select("parent", "a", "b", "relation"), ["parent", "a", "b", "relation"], "left_semi")
    qid = F.col("query_id").cast("string").alias("query_id")
    line = lambda df, section, about: df.select("parent", F.lit(section).alias("section"), about.alias("about"), qid)
    none = F.lit("")
    own = line(misses.where("operation = 'rewrite_skill' and source = target"), 2, F.col("source"))
    own = own.unionByName(line(misses.where("operation = 'add_edge' and target = parent"), 3, F.col("source")))
    own = own.unionByName(line(misses.where("operation = 'rewrite_node' and target = parent"), NODE_IDS, none))
    own = own.unionByName(line(shown.where("relation = 'same'"), 4, F.concat_ws("\n", F.least("a", "b"), F.greatest("a", "b"))))
    own = own.unionByName(line(shown.where(F.col("relation") == ALTERNATIVE), 5, none))
    own = own.unionByName(line(shown, -1, none)).unionByName(line(misses, -1, none))
    return own.distinct()


def _broken(rows: DataFrame, step: int, child: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    """``parent, turn, rule`` of rows that break a rule; ``turn`` is its place in reading order."""
    rule = ct.first_broken(rules)
    turn = F.struct(F.col("section"), F.col("item"), F.lit(step).alias("step"), child.cast("int").alias("child"))
    return rows.select("parent", turn.alias("turn"), rule.alias("rule")).where("rule IS NOT NULL")


def judge(
    proposals: DataFrame, relations: DataFrame, rows: DataFrame, misses: DataFrame, involved: DataFrame, splits: DataFrame, nodes: DataFrame,
    splits_allowed: bool = True,
) -> dict[str, DataFrame]:
    """Verdicts, edits, children and cited requests of proposals (``parent, reply``; JSON text).

    ``verdicts``: parent, rule (null: accepted), section, item.  ``edits``: the items of accepted
    proposals (an added edge without its own evidence is dropped).  ``children``: parent, item,
    child, name, description, skill.  ``cited``: parent, section, item, query_id.  Evidence is
    that of ``evidence.parent_evidence``: ``relations`` and ``rows`` (one per request),
    ``misses``, ``involved`` and ``splits``.  A parent without a reply row has no verdict.
    """
    docs = cut_lineage(proposals.select("parent", F.try_parse_json("reply").alias("doc")))
    every = list(ITEM_FIELDS)
    top = docs.withColumns({"section": F.lit(SHAPE), "item": F.lit(0)})
    broken = [_broken(top, 0, F.lit(0), [("json", F.col("doc").isNotNull()), ("shape", _keys(F.col("doc"), ["parent_rewrite", *every]))])]

    found = cut_lineage(items(docs.where(_keys(F.col("doc"), ["parent_rewrite", *every]))))
    pair = F.concat_ws("\n", F.least("keep", "remove"), F.greatest("keep", "remove"))
    about = F.when(F.col("section").isin(2, 3), F.col("skill")).when(F.col("section") == 4, pair).otherwise("")
    cited = found.select(*ITEM, about.alias("about"), F.explode("ids").alias("query_id"))
    own = cut_lineage(citable(relations, rows, misses))
    supplied = own.where("section = -1").select("parent", "query_id", F.lit(1).alias("given"))
    marked = cited.join(supplied, ["parent", "query_id"], "left").join(own.withColumn("own", F.lit(1)), ["parent", "section", "about", "query_id"], "left")
    counts = marked.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n"), F.count("given").alias("given"), F.count("own").alias("own"))
    known = involved.select("parent", "skill").distinct()
    flag = lambda side: known.select("parent", F.col("skill").alias(side), F.lit(True).alias(f"_{side}"))
    both = relations.where("relation = 'same'").select(
        "parent", F.concat_ws("\n", F.least("a", "b"), F.greatest("a", "b")).alias("about"), (F.col("a_is_source") & F.col("b_is_source")).alias("both")
    )
    full = found.withColumn("about", about).join(counts, ITEM, "left").na.fill(0, ["n", "given", "own"])
    for side in ("skill", "keep", "remove"):
        full = full.join(flag(side), ["parent", side], "left")
    full = cut_lineage(full.join(both, ["parent", "about"], "left"))

    cites = ("ids", F.col("ids").isNotNull() & (F.col("n") >= 2) & (F.col("given") == F.col("n")))
    related = ("unrelated", F.col("own") == F.col("n"))
    shaped = ("item_shape", (F.col("item") >= 0) & F.col("shaped"))
    filled = ("text", ct.nonblank(F.col("text")))
    of = lambda section: full.where(F.col("section") == section)
    zero = F.lit(0)
    broken.append(_broken(of(NODE_IDS).withColumn("section", F.lit(NODE_TEXT)), 0, zero, [("item_shape", F.col("shaped")), filled]))
    broken.append(_broken(of(2), 0, zero, [shaped, ("scope", F.col("_skill")), filled, cites, related]))
    broken.append(_broken(of(3), 0, zero, [shaped, ("scope", F.col("_skill") & (F.col("target") == F.col("parent"))), cites]))
    in_scope = F.col("_keep") & F.col("_remove") & (F.col("keep") != F.col("remove"))
    broken.append(_broken(of(4), 0, zero, [shaped, ("scope", in_scope), cites, ("direction", F.col("both")), related]))
    broken.append(_broken(of(NODE_IDS), 0, zero, [cites, related]))

    listed = F.try_variant_get("doc", "$.children", "array<variant>")
    parts = of(5).withColumn("kids", listed)
    head = [("disabled", F.lit(splits_allowed)), ("item_shape", F.col("shaped") & (F.col("node") == F.col("parent"))), cites, ("children", F.size("kids").between(2, 8))]
    broken.append(_broken(parts.where("item >= 0"), 0, zero, head))
    broken.append(_broken(parts.where("item < 0"), 0, zero, [("item_shape", F.lit(False))]))
    kids = parts.where("item >= 0").select("parent", "section", "item", F.posexplode("kids").alias("child", "kid"))
    kids = kids.select(
        "parent", "section", "item", "child", _keys(F.col("kid"), CHILD_FIELDS).alias("shaped"), F.try_variant_get("kid", "$.name", "string").alias("name"),
        F.try_variant_get("kid", "$.description", "string").alias("description"), F.array_distinct(_strings(F.col("kid"), "move_skill_names")).alias("moves"),
    )
    kids = cut_lineage(kids)
    place = F.struct("item", "child")
    names = kids.groupBy("parent", "name").agg(F.min(place).alias("first")).join(nodes.select("name", F.lit(True).alias("taken")).distinct(), "name", "left")
    moved = kids.select("parent", "section", "item", "child", F.explode("moves").alias("skill"))
    first = moved.groupBy("parent", "skill").agg(F.min(place).alias("first"))
    linked = relations.select("parent", F.explode(F.array("a", "b")).alias("skill")).distinct().withColumn("linked", F.lit(1))
    told = moved.join(first, ["parent", "skill"]).join(known.withColumn("known", F.lit(1)), ["parent", "skill"], "left").join(linked, ["parent", "skill"], "left")
    told = cut_lineage(told.withColumn("again", (F.col("first") != place).cast("int")))
    per_child = told.groupBy("parent", "item", "child").agg(F.count(F.lit(1)).alias("m"), F.count("known").alias("m_known"), F.sum("again").alias("again"))
    judged = kids.join(names, ["parent", "name"], "left").join(per_child, ["parent", "item", "child"], "left")
    child_rules = [
        ("child_shape", F.col("shaped")),
        ("child_name", tx.is_snake(F.col("name")) & F.col("taken").isNull() & (F.col("first") == place)),
        ("fits", ct.nonblank(F.col("description")) & F.lower("description").contains("fits")),
        ("placed_once", (F.col("m") >= 2) & (F.col("m_known") == F.col("m")) & (F.col("again") == 0)),
    ]
    broken.append(_broken(judged, 1, F.col("child"), child_rules))
    per_split = told.groupBy("parent", "item").agg(F.countDistinct("skill").alias("moved"), F.count_if(F.col("linked").isNull()).alias("strange"))
    due = splits.select("parent", "split_required", "minimum_move")
    ends = parts.where("item >= 0").join(per_split, ["parent", "item"], "left").join(due, "parent", "left")
    enough = F.coalesce("moved", zero) >= F.greatest(F.lit(FEWEST_MOVED), F.coalesce("minimum_move", zero))
    broken.append(_broken(ends, 2, zero, [("moved", enough), ("linked", (F.coalesce("strange", zero) == 0) & (F.col("own") >= 2))]))
    n_splits = parts.where("item >= 0").groupBy("parent").agg(F.count(F.lit(1)).alias("n_splits"))
    required = docs.join(due.where("split_required"), "parent", "left_semi").join(n_splits, "parent", "left").withColumns({"section": F.lit(REQUIRED), "item": zero})
    broken.append(_broken(required, 0, zero, [("split_required", F.col("n_splits") == 1)]))

    faults = broken[0]
    for other in broken[1:]:
        faults = faults.unionByName(other)
    worst = faults.groupBy("parent").agg(F.min(F.struct("turn", "rule")).alias("f"))
    verdicts = cut_lineage(docs.select("parent").join(worst, "parent", "left").select("parent", F.col("f.rule").alias("rule"), F.col("f.turn.section").alias("section"), F.col("f.turn.item").alias("item")))
    accepted = verdicts.where("rule IS NULL").select("parent")
    kept = full.where("item >= 0").where((F.col("section") != 3) | (F.col("own") == F.col("n"))).join(accepted, "parent", "left_semi")
    edits = cut_lineage(kept.select(*ITEM, "skill", "target", "keep", "remove", "text"))
    children = kids.join(accepted, "parent", "left_semi").select("parent", "item", "child", "name", "description", F.explode("moves").alias("skill"))
    return {"verdicts": verdicts, "edits": edits, "children": children, "cited": cited.join(edits.select(*ITEM), ITEM, "left_semi").select(*ITEM, "query_id")}


def _chains(merges: DataFrame) -> DataFrame:
    """``skill, live, at``: every skill that ``skill`` turns into along accepted merges, and when."""
    links = cut_lineage(merges.select(F.col("remove").alias("skill"), F.col("keep").alias("live"), F.col("ord").alias("at")))
    known, fresh = links, links
    while True:
        # the skill that was kept is removed later, so times rise along a chain
        step = fresh.alias("f").join(links.alias("l"), F.col("f.live") == F.col("l.skill")).select("f.skill", "l.live", "l.at")
        fresh = cut_lineage(step)
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def apply_in_order(
    skills: DataFrame, nodes: DataFrame, edges: DataFrame, members: DataFrame, judged: dict[str, DataFrame], verified: DataFrame,
) -> dict[str, DataFrame]:
    """The catalog after all accepted proposals, one parent after another in the order of ``nodes.ord``.

    Inside a proposal: rewrite of the parent, of skills, added edges, merges, splits.  Effects
    reach later proposals: a skill is rewritten once; a skill merged away is neither
    rewritten, added, moved nor merged again; an edge is only added where the node does not
    hold the skill, under whatever name, at that time.  ``verified``: x, y, keep of merges
    that were confirmed; others do not happen.  Proposals are not replayed one by one: the
    time of each effect is worked out by joins, and ordered merges in rounds.

    ``skills``: skill, description, merged_into; ``members``: node, skill, pos.  Returns the
    next skills, nodes, edges, members, the aliases and ``patch``: one typed row per effect.
    """
    order = nodes.select(F.col("name").alias("parent"), F.col("ord").alias("node_ord"))
    time = F.struct("node_ord", F.create_map(*[F.lit(x) for kv in APPLIED.items() for x in kv])[F.col("section")].alias("step"), "item")
    edits = cut_lineage(judged["edits"].join(order, "parent").withColumn("at", time))
    of = lambda section: edits.where(F.col("section") == section)

    pairs = of(4).withColumns({"x": F.least("keep", "remove"), "y": F.greatest("keep", "remove")}).select("at", *ITEM, "x", "y")
    agreed = verified.select("x", "y", F.col("keep").alias("stays")).distinct()
    wanted = pairs.join(agreed, ["x", "y"]).select(
        F.col("at").alias("ord"), *ITEM, F.col("stays").alias("keep"), F.when(F.col("stays") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("remove")
    )
    wanted = cut_lineage(wanted)
    gone_before = skills.where("merged_into IS NOT NULL").select("skill")
    merges = cut_lineage(patches.pick_merges(wanted.select("ord", "keep", "remove"), gone_before))
    removed = merges.select(F.col("remove").alias("skill"), F.col("ord").alias("gone_at"))
    chains = cut_lineage(_chains(merges))
    alive = F.col("gone_at").isNull() | (F.col("gone_at") > F.col("at"))

    rewrites = of(2).join(removed, "skill", "left").where(alive)
    rewrites = ordered.first_row(rewrites.select("skill", "text", "at", *ITEM), ["skill"], ["at"])

    adds = of(3).join(removed, "skill", "left").where(alive).select("at", *ITEM, F.col("target").alias("node"), "skill")
    adds = cut_lineage(ordered.first_row(adds, ["node", "skill"], ["at"]))
    held = adds.select("node", "skill").join(members.select("node", "skill").distinct(), ["node", "skill"], "left_semi")
    became = members.select("node", F.col("skill").alias("was")).join(chains.withColumnRenamed("skill", "was"), "was")
    became = adds.select("node", "skill", F.col("at").alias("t")).join(became.withColumnRenamed("live", "skill"), ["node", "skill"]).where("at < t")
    adds = adds.join(held.unionByName(became.select("node", "skill")).distinct(), ["node", "skill"], "left_anti")

    heads = judged["children"].join(order, "parent").withColumn("at", F.struct("node_ord", F.lit(APPLIED[5]).alias("step"), "item"))
    heads = cut_lineage(heads.select("parent", "item", "child", F.col("name").alias("wish"), "description", "skill", "at"))
    kid = ["parent", "item", "child"]
    one = heads.groupBy(*kid, "wish", "description", "at").agg(F.lit(0).alias("z"))
    turn = F.struct("at", "child")
    named = patches.name_children(one.select("parent", F.col("wish").alias("child"), turn.alias("ord")), nodes)
    named = cut_lineage(named.select("parent", F.col("child").alias("wish"), F.col("ord.child").alias("child"), F.col("ord.at.item").alias("item"), "name"))
    placed = heads.join(named.drop("wish"), kid).join(removed, "skill", "left").where(alive)
    placed = cut_lineage(placed.select(*kid, "name", "skill", "at"))

    # members of a node that splits, under the names they have at that time, lose the moved ones
    start = members.select("node", "skill", "pos").unionByName(adds.select("node", "skill", F.col("at.node_ord").cast("long").alias("pos")))
    split_at = placed.groupBy(F.col("parent").alias("node")).agg(F.min("at").alias("t"))
    at_split = start.join(split_at, "node")
    then = at_split.join(chains.select("skill", "live", "at"), "skill").where("at < t").groupBy("node", "skill").agg(F.max_by("live", "at").alias("then"))
    at_split = at_split.join(then, ["node", "skill"], "left").select("node", "skill", "pos", F.coalesce("then", "skill").alias("now"))
    out = placed.select(F.col("parent").alias("node"), F.col("skill").alias("now")).distinct()
    stay = at_split.join(out, ["node", "now"], "left_anti").select("node", "skill", "pos")
    rest = start.join(split_at.select("node"), "node", "left_anti").unionByName(stay)
    rest = rest.unionByName(placed.select(F.col("name").alias("node"), "skill", F.col("at.node_ord").cast("long").alias("pos")))
    final = chains.groupBy("skill").agg(F.max_by("live", "at").alias("last"))
    after = rest.join(final, "skill", "left").select("node", F.coalesce("last", "skill").alias("skill"), "pos")
    after = after.groupBy("node", "skill").agg(F.min("pos").alias("pos"))

    node_text = of(7).select("parent", F.col("text").alias("new"), "at", *ITEM[1:])
    next_nodes = nodes.join(node_text.select(F.col("parent").alias("name"), "new"), "name", "left").select(
        "name", F.coalesce("new", "description").alias("description"), "is_root"
    )
    fresh = one.join(named.drop("wish"), kid)
    next_nodes = next_nodes.unionByName(fresh.select("name", "description", F.lit(False).alias("is_root")))
    next_edges = edges.select("parent", "child").unionByName(fresh.select("parent", F.col("name").alias("child")))
    next_skills = skills.select("skill", "description", "merged_into").join(rewrites.select("skill", "text"), "skill", "left")
    next_skills = next_skills.join(merges.select(F.col("remove").alias("skill"), F.col("keep").alias("into")), "skill", "left")
    next_skills = next_skills.select("skill", F.coalesce("text", "description").alias("description"), F.coalesce("into", "merged_into").alias("merged_into"))

    def patch(rows: DataFrame, operation: str, **columns: str) -> DataFrame:
        text = {n: F.lit(None).cast("string") for n in ("node", "to_node", "skill", "other", "before", "after")}
        text |= {n: F.col(c) for n, c in columns.items()}
        return rows.select(F.lit(operation).alias("operation"), "at", *ITEM, *[c.alias(n) for n, c in text.items()])

    old = nodes.select(F.col("name").alias("parent"), F.col("description").alias("old"))
    was = skills.select("skill", F.col("description").alias("old"))
    happened = merges.select(F.col("ord").alias("at"), "keep", "remove").join(wanted.select(F.col("ord").alias("at"), *ITEM), "at")
    log = patch(node_text.join(old, "parent"), "rewrite_node", node="parent", before="old", after="new")
    log = log.unionByName(patch(rewrites.join(was, "skill"), "rewrite_skill", skill="skill", before="old", after="text"))
    log = log.unionByName(patch(adds, "add_edge", node="node", skill="skill"))
    log = log.unionByName(patch(happened, "merge", skill="remove", other="keep"))
    moves = placed.withColumn("section", F.lit(5))
    log = log.unionByName(patch(moves, "split_rewire", node="parent", to_node="name", skill="skill"))
    aliases = merges.select(F.col("keep").alias("skill"), F.col("remove").alias("alias")).distinct()
    return {"skills": next_skills, "nodes": next_nodes, "edges": next_edges, "members": after, "aliases": aliases, "patch": cut_lineage(log)}


def edits_by_operation(patch: DataFrame) -> DataFrame:
    """Number of edits of each kind."""
    return patch.groupBy("operation").agg(F.count(F.lit(1)).alias("n"))
