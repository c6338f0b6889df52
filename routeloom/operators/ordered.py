"""Ordered scans that stay distributed when one group holds most of the rows.

A plain window sorts a whole group inside one task.  Here rows are range-partitioned on
(keys, order), every slice is reduced to one partial, the partials are prefixed (one row per
group and slice) and joined back, and windows run inside a slice only.  There is one plan,
whatever the sizes of the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from routeloom.session import cut_lineage

_ALL = "_whole_table"
EARLY_LIMIT = 1000


def _fold(agg: str, value: Column) -> Column:
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[agg](value)


def _merge(agg: str, left: Column, right: Column) -> Column:
    if agg in ("sum", "count"):
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return (F.greatest if agg == "max" else F.least)(left, right)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """Running aggregates per group.

    ``specs`` maps an output name to ``(sum|count|max|min, value, inclusive)``;
    an exclusive aggregate covers the rows before the current one.  ``order``
    must be a total order inside each group.
    """
    keys = list(keys)
    if not keys:
        df = df.withColumn(_ALL, F.lit(0))
        keys = [_ALL]

    def frame(parts: list[str], inclusive: bool):
        w = Window.partitionBy(*parts).orderBy(*order)
        return w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    values = {f"_v_{name}": value for name, (_, value, _) in specs.items()}
    # The number of a slice is only stable once written.
    ranged = cut_lineage(
        df.withColumns(values).repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    partials = ranged.groupBy(*keys, "_slice").agg(
        *[_fold(agg, F.col(f"_v_{n}")).alias(f"_p_{n}") for n, (agg, _, _) in specs.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = partials.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        *[
            (F.sum if agg == "count" else lambda c, a=agg: _fold(a, c))(F.col(f"_p_{n}"))
            .over(before)
            .alias(f"_c_{n}")
            for n, (agg, _, _) in specs.items()
        ],
        F.row_number().over(Window.partitionBy(*keys).orderBy("_slice")).alias("_k_part"),
    ).where("_k_part > 1")
    # Only groups that lie in several slices have something to carry: at most one group per slice edge.
    same = ranged["_slice"] == carried["_k_slice"]
    for k in keys:
        same = same & ranged[k].eqNullSafe(carried[f"_k_{k}"])
    out = ranged.join(carried, same, "left")
    for name, (agg, _, inclusive) in specs.items():
        inner = _fold(agg, F.col(f"_v_{name}")).over(frame([*keys, "_slice"], inclusive))
        out = out.withColumn(name, _merge(agg, F.col(f"_c_{name}"), inner))
    helper = ["_k_slice", "_k_part", *[f"_k_{k}" for k in keys]]
    helper += [f"_v_{n}" for n in specs] + [f"_c_{n}" for n in specs] + ["_slice", _ALL]
    return out.drop(*helper)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """1-based position inside each group (``keys=[]`` numbers the whole table)."""
    return running(df, keys, order, {out: ("count", F.lit(1), True)})


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: int,
    after: int,
    aggs: dict[str, Column],
    block: int = 100_000,
) -> DataFrame:
    """Fixed row frames ``[-before, +after]`` over a dense position column.

    Rows are cut into blocks of positions and the few rows next to a block's edge
    are copied into it, so the largest task holds ``block`` rows however large a
    group is.
    """
    block = max(block, before + after + 1)
    home = F.floor((F.col(pos) - 1) / block)
    offset = (F.col(pos) - 1) % block
    targets = F.array_compact(
        F.array(
            home,
            F.when(offset >= block - before, home + 1) if before else F.lit(None).cast("long"),
            F.when((offset < after) & (home > 0), home - 1) if after else F.lit(None).cast("long"),
        )
    )
    copied = df.withColumn("_home", home).withColumn("_block", F.explode(targets))
    w = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(-before, after)
    for name, agg in aggs.items():
        copied = copied.withColumn(name, agg.over(w))
    return copied.where("_block = _home").drop("_block", "_home")


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group; the limit is applied before and after the shuffle.

    Spark limits groups early up to a thousand rows; a longer list by plain columns is
    numbered by the skew-safe scan instead.
    """
    if k > EARLY_LIMIT and all(isinstance(o, str) for o in order):
        return positions(df, keys, order, out).where(F.col(out) <= k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key by a total order, as a mergeable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}") for c in rest]).select(*df.columns)
