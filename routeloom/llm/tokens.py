"""Token counts from flat token files, by a separator scan.

Token files hold ids of fixed width back to back, an end-of-document id after every
document, and no index.  Fixed-size blocks are read by position and searched with
vector comparisons; the documents that cross blocks are stitched by a prefix scan over
one small row per block: the number of separators and the last separator before it.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from routeloom.llm.common import SLICE_ROWS, task_cache
from routeloom.session import cut_lineage, shared_dir, ship_package

WIDTH = 2
BLOCK_BYTES = 4 << 20
GROUP_BLOCKS = 256


@task_cache(2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(df: DataFrame, folder: str, vocab_path: str, pattern: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write one flat file per task and return ``file, ordinal, key``: the order of its documents.

    A task's file has a new name at each attempt, and only files of attempts that ended
    are in the returned rows, so lost executors leave no wrong file.  Null texts are
    documents without tokens.
    """
    ship_package(df.sparkSession)
    id_field = df.select(key).schema[0]
    id_type = to_arrow_type(id_field.dataType)
    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("key", id_type)])

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        enc = encoding(vocab_path, pattern)
        name = f"tokens-{uuid.uuid4().hex}.bin"
        ordinal, out = 0, None
        stop = np.array([end], f"<u{WIDTH}").tobytes()
        held = []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}")
                pieces = []
                for t in part.column(1).to_pylist():
                    if t:
                        pieces.append(np.array(enc.encode_ordinary(t), f"<u{WIDTH}").tobytes())
                    pieces.append(stop)
                out.write(b"".join(pieces))
                n = part.num_rows
                held.append(
                    pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), part.column(0)], schema=schema
                    )
                )
                ordinal += n
        if out is not None:
            out.close()
        yield from held

    ddl = f"file string, ordinal bigint, key {id_field.dataType.simpleString()}"
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, ddl)


def blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    """``file, bytes`` -> ``file, bytes, block``, one row for each part to read."""
    n = F.ceil(F.col("bytes") / block_bytes)
    return files.where("bytes > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))


def scan(spark: SparkSession, folder: str, files: DataFrame, end: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, ordinal, start, n_tokens`` of every document in ``files`` (file, bytes).

    Tokens after the last separator of a file are one more document.  Empty files have none.
    """
    ship_package(spark)
    block_bytes -= block_bytes % WIDTH
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def search(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, total, block in zip(*[c.to_pylist() for c in batch.columns]):
                begin = block * block_bytes
                with store.open_input_file(f"{root}/{name}") as f:
                    raw = f.read_at(min(block_bytes, total - begin), begin)
                ids = np.frombuffer(raw, f"<u{WIDTH}")
                ends = np.flatnonzero(ids == end) + begin // WIDTH
                if begin + len(raw) == total and len(ids) and ids[-1] != end:
                    ends = np.append(ends, total // WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name]),
                        pa.array([block], pa.int64()),
                        pa.array([len(ends)], pa.int64()),
                        pa.array([int(ends[-1]) if len(ends) else None], pa.int64()),
                        pa.array([ends.tolist()], pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    parts = blocks(files, block_bytes).select("file", "bytes", "block")
    found = cut_lineage(
        parts.repartition("file", "block").mapInArrow(search, "file string, block bigint, n bigint, last bigint, ends array<bigint>")
    )
    # Prefix scan in two levels, so that no task sorts all blocks of a large file.
    small = found.select("file", "block", "n", "last").withColumn("grp", F.floor(F.col("block") / GROUP_BLOCKS))
    inside = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        small.groupBy("file", "grp")
        .agg(F.sum("n").alias("gn"), F.max("last").alias("glast"))
        .select("file", "grp", F.coalesce(F.sum("gn").over(over), F.lit(0)).alias("gn"), F.max("glast").over(over).alias("glast"))
    )
    carried = (
        small.withColumn("sn", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .withColumn("slast", F.max("last").over(inside))
        .join(groups, ["file", "grp"])
        .select("file", "block", (F.col("sn") + F.col("gn")).alias("before"), F.coalesce("slast", "glast", F.lit(-1)).alias("prev"))
    )
    ends = found.join(carried, ["file", "block"]).select(
        "file",
        "before",
        F.posexplode(
            F.zip_with("ends", F.concat(F.array("prev"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))), lambda e, p: F.struct(e.alias("e"), p.alias("p")))
        ).alias("k", "x"),
    )
    return ends.where("x.e is not null").select(
        "file",
        (F.col("before") + F.col("k")).alias("ordinal"),
        (F.col("x.p") + 1).alias("start"),
        (F.col("x.e") - F.col("x.p") - 1).alias("n_tokens"),
    )


def count_tokens(df: DataFrame, vocab_path: str, pattern: str, end: int, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key, n_tokens`` of every document, by way of token files in the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    store = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    order = cut_lineage(write_token_files(df, folder, vocab_path, pattern, end, key, text))
    written = order.select("file").distinct()
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    found = scan(spark, folder, files.join(written, "file", "left_semi"), end, block_bytes)
    return order.join(found, ["file", "ordinal"], "left").select(
        F.col("key").alias(key), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")
    )
