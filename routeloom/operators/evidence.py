"""Aggregation of repeated relation and miss evidence per parent node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from routeloom.operators import ordered, reqlog
from routeloom.session import cut_lineage

ALTERNATIVE = "alternative_same_position"
PAIR = ["a", "b", "relation"]
#: Rows of a task where pairs are placed under their parents.
TASK_ROWS = 500_000
KEY = ["parent", *PAIR]


def evidence_parents(relations: DataFrame, members: DataFrame, depth: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parents a relation speaks about: ``(a, b, relation, split_parent, parent)``.

    Deepest common nodes if there are any (ties all); otherwise the stated parent of
    an alternative, or every node of either side for a same-pair.  Works on distinct
    pairs, so a pair repeated in many requests is placed once.
    """
    cols = [*PAIR, "split_parent"]
    # Tasks of a bounded number of rows: their memory stays the same as the relations grow.
    parts = max(int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-relations.count() // TASK_ROWS))
    pairs = cut_lineage(relations.select(*cols).repartition(parts, *cols).distinct())
    placed = members.select("node", "skill").distinct()
    left = placed.select(F.col("node").alias("parent"), F.col("skill").alias("a"))
    right = placed.select(F.col("node").alias("parent"), F.col("skill").alias("b"))
    shared = pairs.repartition(parts, "a").join(left, "a").repartition(parts, "b", "parent")
    shared = shared.join(right, ["b", "parent"], "left_semi").select(*cols, "parent")
    shared = cut_lineage(
        shared.join(depth.withColumnRenamed("name", "parent"), "parent", "left").withColumn(
            "depth", F.coalesce("depth", F.lit(-1))
        )
    )
    w = Window.partitionBy(*cols).orderBy(F.desc("depth"))
    deepest = shared.repartition(parts, *cols).withColumn("_r", F.rank().over(w)).where("_r = 1").select(*cols, "parent")
    apart = pairs.repartition(parts, *cols).join(shared.select(*cols).repartition(parts, *cols).distinct(), cols, "left_anti")
    known = nodes.select(F.col("name").alias("parent"))
    stated = apart.where(F.col("relation") == ALTERNATIVE).withColumn("parent", F.col("split_parent")).join(
        known, "parent", "left_semi"
    ).select(*cols, "parent")
    either = (
        apart.where(F.col("relation") != ALTERNATIVE)
        .withColumn("skill", F.explode(F.array("a", "b")))
        .join(placed, "skill")
        .select(*cols, F.col("node").alias("parent"))
        .distinct()
    )
    return deepest.unionByName(stated).unionByName(either)


def repeated_relations(relations: DataFrame, min_support: int = 2) -> DataFrame:
    """Rows whose pair occurs in at least ``min_support`` requests under any parent.

    A parent's support cannot exceed that count, so pairs seen once are dropped before
    any graph join; the result of ``relation_support`` is unchanged.
    """
    pairs = relations.groupBy(*PAIR)
    if min_support == 2:  # two requests: the smallest and the largest differ
        often = pairs.agg(F.min("query_id").alias("_lo"), F.max("query_id").alias("_hi")).where("_lo < _hi")
    else:
        often = pairs.agg(F.countDistinct("query_id").alias("_q")).where(F.col("_q") >= min_support)
    # Written first, so that its size is known: where few pairs are repeated, the rows need no shuffle.
    return cut_lineage(relations.join(cut_lineage(often.select(*PAIR)), PAIR, "left_semi"))


def relation_rows(relations: DataFrame, parents: DataFrame) -> DataFrame:
    return relations.join(parents, [*PAIR, "split_parent"])


def relation_support(rows: DataFrame, min_support: int = 2) -> DataFrame:
    """Support (distinct requests) per (parent, a, b, relation), at least ``min_support``."""
    return (
        rows.groupBy(*KEY)
        .agg(
            F.countDistinct("query_id").alias("support"),
            F.max(F.col("source") == F.col("a")).alias("a_is_source"),
            F.max(F.col("source") == F.col("b")).alias("b_is_source"),
        )
        .where(F.col("support") >= min_support)
    )


def relation_details(rows: DataFrame, supported: DataFrame) -> DataFrame:
    """All request ids and sources in order, first three reasons and up to five distinctions.

    ``first_ids`` and ``n_sources`` are the digest of the two whole lists; reasons and
    distinctions are cut before they are collected.
    """
    supported = cut_lineage(supported)
    kept = cut_lineage(rows.join(supported.select(*KEY), KEY, "left_semi"))

    def listed(df: DataFrame, value: str, k: int, order: list[str], out: str) -> DataFrame:
        few = ordered.top_k(df, KEY, order, k, "_n")
        packed = F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v"))))
        return few.groupBy(*KEY).agg(F.transform(packed, lambda s: s["v"]).alias(out))

    queries = kept.select(*KEY, "query_id").distinct()
    distinctions = kept.where("distinction <> ''").select(*KEY, "distinction").distinct()
    whole = kept.groupBy(*KEY).agg(
        F.array_sort(F.collect_set("query_id")).alias("ids"), F.array_sort(F.collect_set("source")).alias("sources")
    )
    return (
        supported.join(whole.withColumn("n_sources", F.size("sources").cast("bigint")), KEY)
        .join(listed(queries, "query_id", 2, ["query_id"], "first_ids"), KEY)
        .join(listed(kept.select(*KEY, "query_id", "reason"), "reason", 3, ["query_id"], "reasons"), KEY)
        .join(listed(distinctions, "distinction", 5, ["distinction"], "distinctions"), KEY, "left")
    )


def relations_topk(supported: DataFrame, n: int = 160) -> DataFrame:
    return ordered.top_k(supported, ["parent"], [F.desc("support"), *PAIR], n, "rank")


def miss_rows(diagnoses: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Misses placed under the node they speak about, or under all nodes of the source."""
    known = nodes.select(F.col("name").alias("parent"))
    at_node = diagnoses.where(F.col("operation").isin("rewrite_node", "add_edge")).withColumn("parent", F.col("target"))
    own = members.select(F.col("node").alias("parent"), F.col("skill").alias("source")).distinct()
    at_skill = diagnoses.where("operation = 'rewrite_skill'").join(own, "source")
    return at_node.unionByName(at_skill).join(known, "parent", "left_semi")


MISS = ["parent", "operation", "source", "target"]


def repeated_miss(misses: DataFrame, min_support: int = 2) -> DataFrame:
    """Keep misses whose key occurs in at least ``min_support`` rows."""
    keys = misses.groupBy(*MISS).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_support)
    return misses.join(keys, MISS)


def miss_sample(misses: DataFrame, k: int = 3) -> DataFrame:
    return ordered.top_k(misses, MISS, ["query_id"], k, "sample_no")


def relation_digest(top: DataFrame, cap: int = 0) -> DataFrame:
    """Order in which relations are shown: alternatives first, then support, then names."""
    order = [(F.col("relation") != ALTERNATIVE).cast("int"), F.desc("support"), "a", "b"]
    return ordered.top_k(top.drop("rank"), ["parent"], order, cap or 2**31 - 1, "shown")


def compact_evidence(found: dict[str, DataFrame], skills: DataFrame, cap: int = 0, chars: int = 800) -> DataFrame:
    """The digest of each parent's evidence: first relations, two request ids each, who of the pair was a source, cut descriptions.

    Reasons and distinctions are emptied here; the whole rows stay in ``found["rows"]``.
    """
    shown = relation_digest(found["relations"], cap)
    ids = found["rows"].select(*KEY, "query_id").distinct()
    two = ordered.top_k(ids, KEY, ["query_id"], 2, "_n").groupBy(*KEY)
    two = two.agg(F.array_join(F.array_sort(F.collect_list("query_id")).cast("array<string>"), ",").alias("ids"))
    text = lambda side: skills.select(F.col("skill").alias(side), F.col("description").alias(f"{side}_text"))
    sources = F.concat_ws(",", F.when(F.col("a_is_source"), F.col("a")), F.when(F.col("b_is_source"), F.col("b")))
    rows = shown.join(two, KEY).join(text("a"), "a").join(text("b"), "b").withColumns(
        {"directions": sources, "reason": F.lit("x"), "distinction": F.lit("x")}
    )
    rows = reqlog.compact_payload(rows, {"a_text": chars, "b_text": chars, "reason": 0, "distinction": 0})
    return rows.select(*KEY, "support", "a_is_source", "b_is_source", "shown", "ids", "directions", "a_text", "b_text", "reason", "distinction")


def split_eligibility(top: DataFrame, skills: DataFrame, min_relations: int = 8, min_skills: int = 12, fraction: float = 0.6) -> DataFrame:
    """Per parent: alternatives, their skills, whether a split is due and how much must move."""
    alternatives = top.where(F.col("relation") == ALTERNATIVE)
    known = skills.select("skill").distinct()
    ends = alternatives.select("parent", F.explode(F.array("a", "b")).alias("skill")).distinct().join(
        known, "skill", "left_semi"
    )
    counts = alternatives.groupBy("parent").agg(
        F.count(F.lit(1)).alias("alternatives"), F.sum("support").alias("score")
    )
    sizes = ends.groupBy("parent").agg(F.count(F.lit(1)).alias("n_skills"))
    due = (F.col("alternatives") >= min_relations) & (F.col("n_skills") >= min_skills)
    # The fraction is compared as a percentage to keep the ceiling exact.
    moved = F.ceil(F.col("n_skills") * round(fraction * 100) / 100)
    return counts.join(sizes, "parent", "left").na.fill(0, ["n_skills"]).select(
        "parent", "alternatives", "n_skills", "score", due.alias("eligible"),
        F.when(due, F.greatest(F.lit(min_skills), moved)).otherwise(0).cast("int").alias("minimum_move"),
    )


def select_split_parents(eligibility: DataFrame, n: int = 0) -> DataFrame:
    """The strongest eligible parents, by score then name, both descending; 0 keeps all."""
    due = eligibility.where("eligible").orderBy(F.desc("score"), F.desc("parent"))
    chosen = (due.limit(n) if n > 0 else due).select("parent", F.lit(True).alias("_due"))
    joined = eligibility.join(chosen, "parent", "left")
    required = F.coalesce("_due", F.lit(False))
    return joined.withColumns(
        {"split_required": required, "minimum_move": F.when(required, F.col("minimum_move")).otherwise(0)}
    ).drop("_due")


def involved_skills(top: DataFrame, misses: DataFrame, skills: DataFrame, members: DataFrame) -> DataFrame:
    """Skills named by retained evidence, with direct flag and number of memberships."""
    named = (
        misses.select("parent", F.col("source").alias("skill"))
        .unionByName(top.select("parent", F.explode(F.array("a", "b")).alias("skill")))
        .distinct()
        .join(skills.select("skill").distinct(), "skill", "left_semi")
    )
    placed = members.select("node", "skill").distinct()
    direct = placed.select(F.col("node").alias("parent"), "skill", F.lit(True).alias("_direct"))
    sizes = placed.groupBy("skill").agg(F.count(F.lit(1)).alias("memberships"))
    return (
        named.join(direct, ["parent", "skill"], "left")
        .join(sizes, "skill", "left")
        .select(
            "parent", "skill", F.coalesce("_direct", F.lit(False)).alias("is_direct"),
            F.coalesce("memberships", F.lit(0)).alias("memberships"),
        )
    )


def parent_evidence(
    relations: DataFrame, diagnoses: DataFrame, members: DataFrame, depth: DataFrame, nodes: DataFrame, skills: DataFrame,
    min_support: int = 2, max_relations: int = 160, min_relations: int = 8, min_skills: int = 12,
    fraction: float = 0.6, max_splits: int = 0, indirect: bool = False,
) -> dict[str, DataFrame]:
    """All evidence of a round: retained relations, misses, involved skills and one summary per parent.

    ``rows`` is the payload: every request of every retained relation, with source, reason and
    distinction, one row each (parent, a, b, relation, support, rank, query_id, ...).
    """
    direct = members.groupBy(F.col("node").alias("parent")).agg(F.countDistinct("skill").alias("direct_skills"))
    parents = nodes.select(F.col("name").alias("parent")).join(direct, "parent", "left").na.fill(0, ["direct_skills"])
    if not indirect:
        parents = parents.where("direct_skills > 0")
    relations = repeated_relations(relations, min_support)
    placed = evidence_parents(relations, members, depth, nodes)
    placed_rows = cut_lineage(relation_rows(relations, placed).join(parents.select("parent"), "parent", "left_semi"))
    top = relations_topk(relation_support(placed_rows, min_support), max_relations)
    misses = repeated_miss(miss_rows(diagnoses, members, nodes), min_support).join(
        parents.select("parent"), "parent", "left_semi"
    )
    # Both are read several times below; they are tables of the round in any case.
    top, misses = cut_lineage(top), cut_lineage(misses)
    rows = placed_rows.join(top.select(*KEY, "support", "rank"), KEY)
    splits = select_split_parents(split_eligibility(top, skills, min_relations, min_skills, fraction), max_splits)
    involved = involved_skills(top, misses, skills, members)
    n_rel = top.groupBy("parent").agg(F.count(F.lit(1)).alias("relations"))
    n_miss = misses.groupBy("parent").agg(F.count(F.lit(1)).alias("misses"))
    n_inv = involved.groupBy("parent").agg(F.count(F.lit(1)).alias("involved"))
    summary = (
        parents.join(n_rel, "parent", "left")
        .join(n_miss, "parent", "left")
        .where(F.col("relations").isNotNull() | F.col("misses").isNotNull())
        .join(n_inv, "parent", "left")
        .join(splits.select("parent", "split_required", "minimum_move"), "parent", "left")
        .na.fill(0, ["relations", "misses", "involved", "minimum_move"])
        .na.fill(False, ["split_required"])
    )
    return {"relations": top, "rows": rows, "misses": misses, "involved": involved, "splits": splits, "summary": summary}


def typed_evidence(top: DataFrame, misses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Second pass: same-relations and misses only, the skills they name, parents with nothing dropped."""
    same = top.where(F.col("relation") != ALTERNATIVE)
    names = (
        misses.select("parent", F.col("source").alias("skill"))
        .unionByName(same.select("parent", F.explode(F.array("a", "b")).alias("skill")))
        .distinct()
    )
    return same, misses, names


def merge_candidates(proposed: DataFrame) -> DataFrame:
    """One row per unordered pair: first orientation, number of distinct evidence ids."""
    keyed = proposed.withColumns({"x": F.least("keep", "remove"), "y": F.greatest("keep", "remove")})
    first = keyed.groupBy("x", "y").agg(
        F.min_by(F.struct("keep", "remove"), F.struct("ord")).alias("f"),
        F.countDistinct("query_id").alias("evidence"),
    )
    return first.select("x", "y", F.col("f.keep").alias("keep"), F.col("f.remove").alias("remove"), "evidence")


def pair_verdict(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verified pairs only; the verdict, not the proposal, says which side stays."""
    v = verdicts.where("equivalent").select(
        F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.col("keep").alias("verdict_keep")
    )
    return candidates.join(v, ["x", "y"]).select(
        "x", "y", F.col("verdict_keep").alias("keep"),
        F.when(F.col("verdict_keep") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("remove"), "evidence",
    )
