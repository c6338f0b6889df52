"""Routing graph operators: level loops over DataFrames, lineage cut once per level."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from routeloom.functions import text as tx
from routeloom.operators import ordered
from routeloom.session import cut_lineage


class CycleError(ValueError):
    """A graph or a merge chain loops back on itself."""


def resolve_merges(skills: DataFrame, name: str = "skill", into: str = "merged_into") -> DataFrame:
    """``(name, canonical)`` by pointer doubling: O(log chain) joins over merged rows only."""
    links = cut_lineage(
        skills.where(F.col(into).isNotNull()).select(F.col(name).alias("name"), F.col(into).alias("to"))
    )
    rounds = math.ceil(math.log2(max(2, links.count()))) + 1
    for _ in range(rounds + 1):
        hop = links.select(F.col("name").alias("to"), F.col("to").alias("next"))
        if links.join(hop, "to", "left_semi").isEmpty():
            break
        links = cut_lineage(
            links.join(hop, "to", "left").select("name", F.coalesce("next", "to").alias("to"))
        )
    else:
        raise CycleError("merge chain does not end at a live skill")
    return skills.select(F.col(name).alias("name")).join(links, "name", "left").select(
        "name", F.coalesce("to", "name").alias("canonical")
    )


def integrity_defects(nodes: DataFrame, roots: DataFrame, edges: DataFrame, members: DataFrame, canonical: DataFrame, skills: DataFrame) -> DataFrame:
    """Unknown roots, unknown children and unknown skills, one row each with its kind."""
    names = nodes.select("name")
    bad_roots = roots.join(names, "name", "left_anti").select(
        F.lit("unknown_root").alias("kind"), F.lit(None).cast("string").alias("at"), "name"
    )
    bad_children = edges.select(F.col("parent").alias("at"), F.col("child").alias("name")).join(
        names, "name", "left_anti"
    ).select(F.lit("unknown_child").alias("kind"), "at", "name")
    resolved = members.join(canonical, members.skill == canonical.name, "left").select(
        F.col("node").alias("at"), F.col("skill").alias("name"), F.coalesce("canonical", "skill").alias("live")
    )
    known = skills.select(F.col("skill").alias("live"))
    bad_skills = resolved.join(known, "live", "left_anti").select(F.lit("unknown_skill").alias("kind"), "at", "name")
    return bad_roots.unionByName(bad_children).unionByName(bad_skills)


def infer_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("name").join(edges.select(F.col("child").alias("name")), "name", "left_anti")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a directed cycle (or between two): both ends are stripped until nothing changes."""
    left = cut_lineage(edges.select("parent", "child").distinct())
    size = left.count()
    while size:
        sources = left.select(F.col("parent").alias("child"))
        sinks = left.select(F.col("child").alias("parent"))
        left = cut_lineage(left.join(sources, "child", "left_semi").join(sinks, "parent", "left_semi"))
        now = left.count()
        if now == size:
            break
        size = now
    return left.select(F.explode(F.array("parent", "child")).alias("name")).distinct()


def longest_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest path from a root per reachable node; a cycle is an error."""
    edges = cut_lineage(edges.select("parent", "child").distinct())
    limit = edges.count() + 1
    level = nodes.where("is_root").select("name", F.lit(0).alias("depth"))
    seen = [cut_lineage(level)]
    while True:
        step = seen[-1].join(edges, F.col("name") == F.col("parent")).select(
            F.col("child").alias("name"), F.lit(len(seen)).alias("depth")
        )
        step = cut_lineage(step.distinct())
        if step.isEmpty():
            break
        if len(seen) > limit:
            raise CycleError("routing graph has a cycle")
        seen.append(step)
    rows = seen[0]
    for other in seen[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("name").agg(F.max("depth").alias("depth"))


def descendants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, below)`` closure, every node below itself included.

    A round writes only the pairs it found; what is known is the union of the rounds.
    """
    edges = cut_lineage(edges.select("parent", "child").distinct())
    fresh = cut_lineage(nodes.select(F.col("name").alias("node"), F.col("name").alias("below")))
    known = fresh
    while True:
        step = fresh.join(edges, F.col("below") == F.col("parent")).select("node", F.col("child").alias("below"))
        fresh = cut_lineage(step.distinct().join(known, ["node", "below"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def reachable_skills(nodes: DataFrame, edges: DataFrame, members: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Live skills in the closure of each node."""
    direct = members.select(F.col("node").alias("below"), "skill")
    if canonical is not None:
        direct = direct.join(canonical, F.col("skill") == F.col("name")).select("below", F.col("canonical").alias("skill"))
    return descendants(nodes, edges).join(direct.distinct(), "below").select("node", "skill").distinct()


def lexical_score(query: Column, text: Column, basis: str = "query") -> Column:
    """Shared words in percent of the query's words (or of the text's), rounded down."""
    shared = F.size(F.array_intersect(query, text))
    whole = F.size(query if basis == "query" else text)
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(F.lit(100) * shared / whole)).cast("int")


def rare_words(cards: DataFrame, threshold: int) -> DataFrame:
    """Cards with one row per word that a covering query has to share.

    A card covered to ``threshold`` percent shares one of its
    ``n - ceil(n*threshold/100) + 1`` rarest words with the query.
    """
    words = cards.select("name", F.explode("words").alias("w"))
    spread = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rarest = words.join(spread, "w").groupBy("name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda s: s["w"]).alias("_rare")
    )
    need = F.ceil(F.size("words") * threshold / 100)
    few = F.slice("_rare", F.lit(1), (F.size("words") - need + 1).cast("int"))
    return cards.join(rarest, "name").withColumn("w", F.explode(few)).select("name", "words", "w")


def choose_by_text(queries: DataFrame, cards: DataFrame, threshold: int) -> DataFrame:
    """Cards whose words are covered to ``threshold`` percent by a query, without a cross join."""
    asked = queries.select("query_id", F.col("words").alias("q"), F.explode("words").alias("w"))
    return _covered(asked.join(rare_words(cards, threshold), "w"), threshold)


def _covered(met: DataFrame, threshold: int) -> DataFrame:
    score = lexical_score(F.col("q"), F.col("words"), "description").alias("score")
    via = ["parent"] if "parent" in met.columns else []
    return met.select("query_id", *via, "name", score).where(F.col("score") >= threshold).distinct()


def node_cards(nodes: DataFrame, stop: tuple[str, ...] = ("fits",)) -> DataFrame:
    """Node names with the words of their description."""
    words = F.array_except(tx.token_set(F.col("description")), F.array(*[F.lit(s) for s in stop]))
    return nodes.select("name", "is_root", words.alias("words"))


def route_trace(queries: DataFrame, nodes: DataFrame, edges: DataFrame, threshold: int = 90) -> DataFrame:
    """Chosen nodes with where they came from: ``(query_id, level, parent, name, score)``, level by level.

    All children of a chosen node are asked on the next level.  A node met through several
    chosen parents has a row for each; roots have a null parent.  Repeats are removed inside
    a level only, so a node reached at two depths is asked twice.  A path without a cycle has
    no more levels than there are nodes; a longer one is an error.
    """
    cards = cut_lineage(node_cards(nodes))
    most = cards.count()
    asked = cut_lineage(queries.select("query_id", tx.token_set(F.col("query")).alias("words")))
    chosen = choose_by_text(asked, cards.where("is_root").select("name", "words"), threshold)
    first = chosen.select("query_id", F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent"), "name", "score")
    levels = [cut_lineage(first)]
    keyed = rare_words(cards.select("name", "words"), threshold)
    children = cut_lineage(edges.join(keyed, F.col("child") == F.col("name")).select("parent", "name", "words", "w"))
    while True:
        # A child is met only through a word it must share, however many siblings it has.
        frontier = levels[-1].select("query_id", F.col("name").alias("parent")).distinct().join(asked, "query_id")
        frontier = frontier.select("query_id", "parent", F.col("words").alias("q"), F.explode("words").alias("w"))
        picked = _covered(frontier.join(children, ["parent", "w"]), threshold)
        picked = cut_lineage(picked.select("query_id", F.lit(len(levels) + 1).alias("level"), "parent", "name", "score"))
        if picked.isEmpty():
            break
        if len(levels) >= most:
            raise CycleError("routing did not end; check the graph for cycles")
        levels.append(picked)
    rows = levels[0]
    for other in levels[1:]:
        rows = rows.unionByName(other)
    return rows


def route_dag(queries: DataFrame, nodes: DataFrame, edges: DataFrame, threshold: int = 90) -> DataFrame:
    """Chosen nodes ``(query_id, level, name, score)`` of ``route_trace``, whatever their parent."""
    return route_trace(queries, nodes, edges, threshold).select("query_id", "level", "name", "score").distinct()


def routing_result(trace: DataFrame, nodes: DataFrame, edges: DataFrame, members: DataFrame, canonical: DataFrame) -> dict[str, DataFrame]:
    """What a routing run returns, as tables.

    ``selected``: query_id, name, level and score where it was first chosen, ``kind`` (root or
    descendant) and ``is_leaf`` (it holds skills itself); ``levels``: query_id, level, how many
    nodes were asked and chosen; ``candidates``: query_id, skill and the place it was seen
    first; ``below``: query_id, name and every node reachable from a selected one.
    """
    chosen = trace.select("query_id", "level", "name", "score").distinct()
    place = F.struct("level", (-F.col("score")).alias("weak"))
    first = chosen.groupBy("query_id", "name").agg(F.min(place).alias("at"))
    kinds = nodes.select("name", F.when(F.col("is_root"), "root").otherwise("descendant").alias("kind"))
    holding = members.select(F.col("node").alias("name"), F.lit(True).alias("_holds")).distinct()
    selected = first.join(kinds, "name").join(holding, "name", "left").select(
        "query_id", "name", F.col("at.level").alias("level"), (-F.col("at.weak")).alias("score"), "kind", F.coalesce("_holds", F.lit(False)).alias("is_leaf")
    )
    picked = chosen.groupBy("query_id", "level").agg(F.countDistinct("name").alias("chosen"))
    links = edges.select(F.col("parent").alias("name"), "child").distinct()
    asked = chosen.join(links, "name").groupBy("query_id", (F.col("level") + 1).alias("level")).agg(F.countDistinct("child").alias("asked"))
    roots = nodes.where("is_root").agg(F.count(F.lit(1)).alias("asked")).first()["asked"]
    levels = asked.join(picked, ["query_id", "level"], "full_outer").select(
        "query_id", "level", F.when(F.col("level") == 1, F.lit(roots)).otherwise(F.col("asked")).alias("asked"), F.coalesce("chosen", F.lit(0)).alias("chosen")
    )
    closure = descendants(nodes, edges).withColumnRenamed("node", "name")
    below = selected.select("query_id", "name").join(closure, "name").select("query_id", "below").distinct()
    return {"selected": selected, "levels": levels, "candidates": candidate_union(chosen, members, canonical), "below": below}


def candidate_union(chosen: DataFrame, members: DataFrame, canonical: DataFrame) -> DataFrame:
    """Live skills of all chosen nodes, once each, with the place they were first seen."""
    live = members.join(canonical, F.col("skill") == F.col("name")).select("node", "pos", F.col("canonical").alias("skill"))
    met = chosen.join(live, chosen.name == live.node)
    place = F.struct("level", (-F.col("score")).alias("s"), F.col("name").alias("n"), "pos")
    return met.groupBy("query_id", "skill").agg(F.min(place).alias("seen"))


def request_classes(queries: DataFrame) -> DataFrame:
    """``(query_id, like)``: requests that ask with the same words share the smallest of their ids.

    What is routed, reviewed and ranked depends on the words alone, so one request of a class is enough.
    """
    words = F.array_join(F.array_sort(tx.token_set(F.col("query"))), " ")
    asked = queries.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set(words)), "|").alias("_words"))
    return _classes(cut_lineage(asked), "_words")


def trace_classes(trace: DataFrame) -> DataFrame:
    """``(query_id, like)``: requests whose ``route_trace`` is the same share the smallest of their ids."""
    way = F.array_sort(F.collect_set(F.struct("level", "parent", "name", "score")))
    return _classes(cut_lineage(trace.groupBy("query_id").agg(way.alias("_way"))), "_way")


def _classes(keyed: DataFrame, key: str) -> DataFrame:
    first = keyed.groupBy(key).agg(F.min("query_id").alias("like"))
    return cut_lineage(keyed.join(first, key).select("query_id", "like"))


def candidate_counts(chosen: DataFrame, held: DataFrame) -> DataFrame:
    """``query_id, candidates``: live skills (``held``: node, skill) of all chosen nodes, once each.

    Skills that lie in the same nodes are counted together, and so are requests that chose the
    same nodes: the candidates themselves are never listed.
    """
    lies = held.groupBy("skill").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    lies = lies.groupBy("nodes").agg(F.count(F.lit(1)).alias("n")).withColumn("_place", F.monotonically_increasing_id())
    lies = cut_lineage(lies).select("_place", "n", F.explode("nodes").alias("name"))
    picked = cut_lineage(chosen.groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("names")))
    kinds = cut_lineage(picked.select("names").distinct().withColumn("_kind", F.monotonically_increasing_id()))
    met = kinds.select("_kind", F.explode("names").alias("name")).join(lies, "name").select("_kind", "_place", "n").distinct()
    counts = kinds.join(met.groupBy("_kind").agg(F.sum("n").alias("candidates")), "_kind").select("names", "candidates")
    return picked.join(counts, "names").select("query_id", "candidates")


def review_candidates(
    chosen: DataFrame, members: DataFrame, canonical: DataFrame, queries: DataFrame, docs: DataFrame, threshold: int, k: int | None = None
) -> DataFrame:
    """Candidate union with its lexical review: ``query_id, skill, seen, score, applicable``.

    ``queries``: query_id, q; ``docs``: skill, d (word arrays).  Skills of a node with the same
    words get one score.  With ``k`` only applicable candidates come back, and of these at least
    the first ``k`` of every request by score and place seen: in a node the first ``k`` skills of
    equal words, then the first ``k`` of these groups, so a request's rows do not grow with its nodes.
    """
    live = members.join(canonical, F.col("skill") == F.col("name")).select("node", "pos", F.col("canonical").alias("skill"))
    told = docs.groupBy("skill").agg(F.array_sort(F.collect_set(F.array_sort("d"))).alias("ds"))
    live = live.groupBy("node", "skill").agg(F.min("pos").alias("pos")).join(told, "skill")
    if k is not None:
        live = ordered.top_k(live, ["node", "ds"], ["pos", "skill"], k, "_at")
    groups = cut_lineage(
        live.groupBy("node", "ds").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "skill"))).alias("skills"))
    )
    asked = queries.groupBy("query_id").agg(F.collect_set(F.array_sort("q")).alias("qs"))
    place = F.min(F.struct("level", (-F.col("score")).alias("s"))).alias("at")
    # The join multiplies rows: an explicit partition count keeps it parallel, as small inputs
    # would be coalesced before they grow.
    parts = int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = chosen.groupBy("query_id", "name").agg(place).join(asked, "query_id").repartition(parts, "query_id")
    score = F.array_max(F.flatten(F.transform("qs", lambda q: F.transform("ds", lambda d: lexical_score(q, d)))))
    met = asked.join(groups, F.col("name") == F.col("node")).select("query_id", "name", "at", "first", "skills", score.alias("score"))
    if k is not None:
        met = ordered.top_k(met.where(F.col("score") >= threshold), ["query_id", "name"], [F.desc("score"), "first"], k, "_at")
    each = met.select("query_id", "name", "at", "score", F.inline("skills"))
    seen = F.struct(F.col("at.level").alias("level"), F.col("at.s").alias("s"), F.col("name").alias("n"), "pos").alias("seen")
    got = each.select("query_id", "skill", seen, "score").groupBy("query_id", "skill").agg(F.min("seen").alias("seen"), F.max("score").alias("score"))
    return got.withColumn("applicable", F.col("score") >= threshold)


def skill_memberships(members: DataFrame) -> DataFrame:
    """Node names per skill, sorted."""
    return members.groupBy("skill").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def split_parent_load(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct-skill count of nodes that have children."""
    parents = edges.select(F.col("parent").alias("node")).distinct()
    return parents.join(members.groupBy("node").agg(F.countDistinct("skill").alias("n")), "node", "left").select(
        "node", F.coalesce("n", F.lit(0)).alias("direct_skills")
    )
