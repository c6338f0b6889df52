"""Vectors on disk in group order, with offsets, so that a group is a range read.

Rows are numbered in the order (group, key) and cut into folders of a fixed number of rows.
The offsets table holds one row per group (CSR: start, stop).  A group's rows lie in few
folders, which a read finds from the offsets and asks for by folder and row number: other
folders are never opened, and inside a folder Parquet skips by row number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from routeloom.functions import vector as vx
from routeloom.operators import ordered

FOLDER_ROWS = 1 << 16


@dataclass
class VectorStore:
    """``rows``: row, group, key, vec and folder; ``offsets``: group, start, stop; ``facts``: dims, n, folder_rows, unit."""

    rows: DataFrame
    offsets: DataFrame
    facts: dict

    def group(self, value) -> DataFrame:
        """``key, vec`` of one group; an unknown group has no rows."""
        at = self.offsets.where(F.col("group").eqNullSafe(F.lit(value))).first()
        return self._span(0, 0) if at is None else self._span(at["start"], at["stop"])

    def span(self, first: int, last: int) -> DataFrame:
        """Rows ``first`` to before ``last`` by number: several neighbouring groups at once."""
        return self._span(first, last)

    def groups(self, wanted: DataFrame) -> DataFrame:
        """``group, key, vec`` of many groups (a table with a column ``group``).

        The folders that they touch are joined, so Spark prunes folders while it runs.
        """
        size = self.facts["folder_rows"]
        spans = self.offsets.join(wanted.select("group").distinct(), "group", "left_semi").where("stop > start")
        folders = spans.select("start", "stop", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))).alias("folder"))
        met = self.rows.join(folders.withColumn("folder", F.col("folder").cast("long")), "folder")
        return met.where((F.col("row") >= F.col("start")) & (F.col("row") < F.col("stop"))).select("group", "key", "vec")

    def _span(self, first: int, last: int) -> DataFrame:
        size = self.facts["folder_rows"]
        folders = F.col("folder").between(first // size, max(first, last - 1) // size)
        return self.rows.where(folders & (F.col("row") >= first) & (F.col("row") < last)).select("key", "vec")


def save(df: DataFrame, path: str, group: str, key: str, vec: str, folder_rows: int = FOLDER_ROWS) -> None:
    """Write a store.  All vectors need the same length; a vector that is null or of another length ends the run."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{group}`").alias("group"), F.col(f"`{key}`").alias("key"), F.col(f"`{vec}`").alias("vec"))
    sizes = rows.agg(F.min(F.coalesce(F.size("vec"), F.lit(-1))).alias("a"), F.max(F.size("vec")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if sizes["n"] and (sizes["a"] != sizes["b"] or sizes["a"] < 0):
        raise ValueError("vectors are null or differ in length")
    placed = ordered.positions(rows, [], ["group", "key"], "row").withColumn("row", F.col("row") - 1)
    numbered = placed.withColumn("folder", F.floor(F.col("row") / folder_rows))
    dealt = numbered.repartitionByRange("folder", "row").sortWithinPartitions("folder", "row")
    dealt.write.partitionBy("folder").parquet(f"{path}/rows")
    counts = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    offsets = ordered.running(counts, [], ["group"], {"start": ("sum", F.col("n"), False)})
    offsets.select("group", "start", (F.col("start") + F.col("n")).alias("stop")).write.parquet(f"{path}/offsets")
    unit = rows.agg(F.coalesce(F.max(F.abs(vx.norm(F.col("vec")) - 1)), F.lit(0.0)).alias("off")).first()["off"] <= 1e-5
    facts = [(sizes["b"] or 0, sizes["n"], folder_rows, unit)]
    spark.createDataFrame(facts, "dims int, n long, folder_rows long, unit boolean").coalesce(1).write.parquet(f"{path}/facts")


def open_store(spark: SparkSession, path: str) -> VectorStore:
    """A saved store; a store whose offsets do not cover its rows is an error."""
    facts = spark.read.parquet(f"{path}/facts").first().asDict()
    offsets = spark.read.parquet(f"{path}/offsets")
    covered = offsets.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("n")).first()["n"]
    if covered != facts["n"]:
        raise ValueError(f"offsets cover {covered} of {facts['n']} vectors")
    if not facts["n"]:
        schema = offsets.schema
        rows = spark.createDataFrame([], f"row long, group {schema['group'].dataType.simpleString()}, key long, vec array<double>, folder long")
    else:
        rows = spark.read.parquet(f"{path}/rows").withColumn("folder", F.col("folder").cast("long"))
    return VectorStore(rows, offsets, facts)
