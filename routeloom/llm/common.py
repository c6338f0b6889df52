"""Helpers of the corpus operators: reading tables, Arrow row mapping, shared files, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from routeloom.session import cut_lineage, ship_package, write_shared

SLICE_ROWS = 512
#: Texts of a slice, unless it is one row.
SLICE_BYTES = 4 << 20
_CACHES: list = []
_SERVED: list[str] = [""]


def task_cache(maxsize: int) -> Callable:
    """``lru_cache`` for what tasks load; a worker keeps it only while it serves the same operator."""

    def wrap(fn: Callable) -> Callable:
        cached = functools.lru_cache(maxsize=maxsize)(fn)
        _CACHES.append(cached)
        return cached

    return wrap


def begin(operator: str) -> None:
    """Start of a task: a worker that served another operator first lets go of what that one loaded.

    Workers are reused from stage to stage, so that models of earlier stages would add up.
    """
    if _SERVED[0] != operator:
        _SERVED[0] = operator
        for cached in _CACHES:
            if cached.__module__ != operator:
                cached.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _return_heap()


def _return_heap() -> None:
    """Give freed memory back to the machine, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``SLICE_ROWS`` rows and, above one row, ``SLICE_BYTES`` bytes of texts."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    upto = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        full = int(np.searchsorted(upto, before + SLICE_BYTES, "right"))
        end = min(at + SLICE_ROWS, max(full, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Evaluation rows: crc32 of the id as text divisible by five; a null id counts as a learning row."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fresh(name: str) -> str:
    """A column or file name that no input carries."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def append(
    df: DataFrame, inputs: Sequence[str], fn: Callable[..., Sequence[Sequence]], schema: str
) -> DataFrame:
    """``df`` with columns computed from ``inputs`` by ``fn(*lists) -> lists``, in slices of bounded size.

    Rows, their order inside a task, and all other columns stay as they are.  An input
    column that has the name of a computed one is replaced.
    """
    ship_package(df.sparkSession)
    added = T.StructType.fromDDL(schema)
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in names]
    sent = [F.col(f"`{f.name}`") for f in kept] + [F.col(f"`{c}`").alias(f"_in{k}") for k, c in enumerate(inputs)]
    types = [to_arrow_type(f.dataType) for f in added]
    fields = [pa.field(f.name, t) for f, t in zip(added, types)]
    n_kept, operator = len(kept), fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        for batch in batches:
            out_schema = pa.schema([batch.schema.field(k) for k in range(n_kept)] + fields)
            for part in slices(batch):
                made = fn(*[part.column(k).to_pylist() for k in range(n_kept, part.num_columns)])
                columns = [part.column(k) for k in range(n_kept)]
                columns += [pa.array(values, type=t) for values, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return df.select(*sent).mapInArrow(run, T.StructType(kept + list(added)))


def map_batches(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterator[Sequence[Sequence]]], schema: str) -> DataFrame:
    """Whole-task mapping: ``fn`` gets slices of Python columns and yields columns of ``schema``."""
    ship_package(df.sparkSession)
    made = T.StructType.fromDDL(schema)
    out_schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in made])
    operator = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)

        def lists():
            for batch in batches:
                for part in slices(batch):
                    yield [c.to_pylist() for c in part.columns]

        for columns in fn(lists()):
            arrays = [pa.array(values, type=f.type) for values, f in zip(columns, out_schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    return df.mapInArrow(run, made)


def distribute(spark: SparkSession, content: bytes, label: str) -> str:
    """Send a bounded file to every machine; ``local_path`` opens it inside tasks."""
    address = write_shared(spark, label, content)
    spark.sparkContext.addFile(address)
    return os.path.basename(address)


def local_path(name: str) -> str:
    return SparkFiles.get(name)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) by alternating star contraction.

    Every round joins and groups edges only; a node with very many neighbours is
    handled by partial minima, never gathered.  Ends when no edge changes.
    """
    links = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    while True:
        # large star: bigger neighbours of a node move to its smallest neighbour
        both = links.union(links.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            links.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(low, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # small star: smaller neighbours of a node, and the node, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after = cut_lineage(small)
        if links.exceptAll(after).isEmpty() and after.exceptAll(links).isEmpty():
            break
        links = after
    return nodes.join(links.select(F.col("u").alias("id"), F.col("v").alias("_root")), "id", "left").select(
        "id", F.coalesce("_root", "id").alias("component")
    )
