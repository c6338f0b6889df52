"""Ranking, sampling, budgets and evidence excerpts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from routeloom.functions import text as tx
from routeloom.operators import ordered
from routeloom.operators.contracts import pin


def rank_topk(reviews: DataFrame, query: str, seen: Sequence[str], k: int = 10) -> DataFrame:
    """Applicable candidates by score, ties by first-seen place; 1-based rank up to ``k``."""
    accepted = reviews.where("applicable")
    return ordered.top_k(accepted, [query], [F.desc("score"), *seen], k, "rank")


def review_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 8) -> DataFrame:
    """Batch number and place inside the batch for an ordered candidate list."""
    placed = ordered.positions(df, keys, order, "pos")
    return placed.withColumns(
        {"batch": F.floor((F.col("pos") - 1) / size), "slot": (F.col("pos") - 1) % size}
    )


def round_robin_sample(df: DataFrame, category: str, order: Sequence[str], n: int) -> DataFrame:
    """Take categories in turn (sorted by name), one row each, until ``n`` rows are taken."""
    turns = ordered.top_k(df, [category], list(order), n, "turn")
    return turns.orderBy("turn", category).limit(n)


def slice_rows(df: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows ``[offset, offset+limit)`` in source order; 0 takes the rest."""
    placed = ordered.positions(df, [], order, "_pos").where(F.col("_pos") > offset)
    if limit:
        placed = placed.where(F.col("_pos") <= offset + limit)
    return placed.drop("_pos")


def char_budget(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, budget: int, joint: int = 0
) -> DataFrame:
    """Keep text until the budget is used up: the crossing row is cut, later rows dropped.

    Only lengths are scanned; the texts that stay meet their place by (keys, order), which
    has to be unique.
    """
    names = [*keys, *order]
    lengths = df.select(*names, F.length(text).alias("_length"))
    spent = ordered.running(lengths, keys, order, {"used": ("sum", F.col("_length") + joint, False)})
    kept = spent.where(F.col("used") < budget).select(*[F.col(c).alias(f"_k_{c}") for c in names], "used")
    met = None
    for c in names:
        same = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        met = same if met is None else met & same
    room = F.lit(budget) - F.col("used")
    return df.join(kept, met).drop(*[f"_k_{c}" for c in names]).withColumns(
        {
            "truncated": F.length(text) > room,
            text: F.substring(F.col(text), F.lit(1), room.cast("int")),
        }
    )


def dense_ids(df: DataFrame, order: Sequence[str], out: str, pattern: str) -> DataFrame:
    """Zero-padded identifiers by sorted order over the whole table."""
    placed = ordered.positions(df, [], order, "_n")
    return placed.withColumn(out, F.format_string(pattern, F.col("_n"))).drop("_n")


def hit_flags(rank: Column) -> dict[str, Column]:
    return {f"hit_{k}": F.coalesce(rank <= k, F.lit(False)) for k in (1, 5, 10)}


def cumulative_texts(df: DataFrame, key: str, level: str, text: str, levels: Sequence[str], pos: str | None = None) -> DataFrame:
    """For each level the texts of all levels up to it, in the fixed level order.

    Several texts of a level are joined by line breaks, in the order of ``pos``.
    """
    at = F.col(pos) if pos else F.lit(0)

    def joined(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when((F.col(level) == name) & F.col(text).isNotNull(), F.struct(at.alias("at"), F.col(text).alias("t")))))
        return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: r["t"]), "\n"))

    wide = df.groupBy(key).agg(*[joined(name).alias(f"_{i}") for i, name in enumerate(levels)])
    upto = [
        F.when(
            F.col(f"_{i}").isNotNull(),
            F.struct(
                F.lit(name).alias("level"),
                F.concat_ws("\n", *[F.col(f"_{j}") for j in range(i + 1)]).alias("request"),
            ),
        )
        for i, name in enumerate(levels)
    ]
    return wide.select(key, F.inline(F.array_compact(F.array(*upto))))


def line_context(lines: DataFrame, keys: Sequence[str], pos: str, hit: str, reach: int = 2) -> DataFrame:
    """Every line within ``reach`` lines of a hit, from a dense line number."""
    near = ordered.trailing(lines, keys, pos, reach, reach, {"near": F.max(F.col(hit).cast("int"))})
    return near.where("near = 1").drop("near")


def evidence_excerpt(
    files: DataFrame,
    owner: str,
    path: str,
    text: str,
    suffix: Column,
    is_index: Column,
    line_chars: int = 1200,
    hit_chars: int = 18_000,
    owner_chars: int = 50_000,
    max_files: int = 80,
) -> DataFrame:
    """Signal lines with two lines of context per source file, under the character budgets.

    Context lines shared by two hits count twice towards the per-file stop and are
    kept once.  A file is one row, so its lines are handled with array functions
    inside the row; only the budget over the files of an owner needs an order.
    """
    ranked = ordered.top_k(files, [owner], [F.col("pref"), F.col(path)], max_files, "file_no")
    clean = tx.break_markup(tx.scrub_data_uri(F.col(text)), suffix)
    rows = pin(ranked, {"_lines": F.split(F.regexp_replace(clean, "\n\\z", ""), "\n"), "_index": is_index})
    flags = F.transform("_lines", lambda l, i: F.when(tx.signal_line(l), i + 1))
    rows = pin(rows, {"_hits": F.array_compact(flags)})

    def label(n: Column) -> Column:
        return F.concat(n.cast("string"), F.lit(": "), F.substring(F.element_at("_lines", n), 1, line_chars))

    first = lambda h: F.greatest(F.lit(1), h - 2)
    last = lambda h: F.least(F.size("_lines"), h + 2)
    sized = F.transform(
        "_hits",
        lambda h: F.struct(
            h.alias("h"),
            F.aggregate(F.sequence(first(h), last(h)), F.lit(0), lambda s, n: s + F.length(label(n))).alias("size"),
        ),
    )
    rows = pin(rows, {"_sized": sized})
    # Fold over the hits: (characters so far, last hit still inside the limit).
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("stop"))
    folded = F.aggregate(
        "_sized",
        state,
        lambda s, x: F.struct(
            F.when(s["used"] >= hit_chars, s["used"]).otherwise(s["used"] + x["size"]).alias("used"),
            F.when(s["used"] >= hit_chars, s["stop"]).otherwise(x["h"]).alias("stop"),
        ),
    )
    rows = pin(rows, {"_stop": folded["stop"]})
    kept = F.filter("_hits", lambda h: h <= F.col("_stop"))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(kept, lambda h: F.sequence(first(h), last(h))))))
    fallback = F.transform(F.slice("_lines", 1, 80), lambda l: F.substring(l, 1, 500))
    shown = F.when(F.size("_hits") > 0, F.transform(numbers, label)).when(F.col("_index"), F.array_distinct(fallback))
    block = F.concat(F.lit("FILE "), F.col(path), F.lit("\n"), F.array_join(shown, "\n"))
    rows = pin(rows, {"block": block})
    blocks = rows.where("block IS NOT NULL").select(owner, path, "file_no", F.size("_hits").alias("n_hits"), "block")
    return char_budget(blocks, [owner], ["file_no"], "block", owner_chars)
