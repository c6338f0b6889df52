"""WARC archives: writing records with segments and chunked framing, and reading them back whole.

A block longer than a segment is cut into a first record and continuation records.
Reading groups continuations by the record they belong to, orders them by segment
number, verifies the total length, and decodes the chunked transfer framing.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from routeloom.llm.common import append
from routeloom.session import cut_lineage, ship_package

SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 8 << 10
FILE_RECORDS = 4_000
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def with_roles(df: DataFrame, key: str = "page_id", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """``key, url, payload, digest, n, refers_to``: of equal payloads of ``least`` bytes or more the smallest key is the response.

    A null html is an empty payload.  A null key is never the smallest while another has the
    payload; rows that repeat the smallest key are responses all of them.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    pages = df.select(F.col(f"`{key}`").alias("key"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    # Narrow and pre-aggregated; stored, so that the join below knows how small it is.
    shared = cut_lineage(
        pages.where(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and first_key is not null")
        .drop("copies")
    )
    other = F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    return pages.join(shared, "digest", "left").select(
        "key", "url", "payload", "digest", "n", F.when(other, F.col("first_key")).alias("refers_to")
    )


def chunked(payload: Column, size: int) -> Column:
    """The payload in chunked transfer framing."""
    n = F.octet_length(payload)
    text = payload.cast("string")
    part = lambda i: F.substring(payload, i * size + 1, F.lit(size))
    frames = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / size), F.lit(0)).cast("int")),
        lambda i: F.concat(F.lower(F.hex(F.octet_length(part(i)))), F.lit(CRLF), part(i).cast("string"), F.lit(CRLF)),
    )
    small = F.concat(F.lower(F.hex(n)), F.lit(CRLF), text, F.lit(CRLF))
    return F.concat(
        F.when(n == 0, F.lit("")).when(n <= size, small).otherwise(F.array_join(frames, "")), F.lit("0" + END)
    )


def records(
    roles: DataFrame, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES
) -> DataFrame:
    """``record``: one WARC record (bytes as a string) for each segment of each row."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), chunked(F.col("payload"), chunk))).cast("binary")
    number = F.concat(F.lit("<urn:record:"), F.monotonically_increasing_id().cast("string"), F.lit(">"))
    base = roles.select("key", "url", "digest", "n", "refers_to", block.alias("block"), number.alias("record_id"))
    base = base.withColumn("length", F.octet_length("block")).withColumn("count", F.ceil(F.col("length") / segment).cast("int"))
    parts = base.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("count"))))
    piece = F.when(F.col("count") == 1, F.col("block")).otherwise(F.substring("block", (F.col("k") - 1) * segment + 1, F.lit(segment)))
    parts = parts.withColumn("piece", piece)
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))
    first = F.col("k") == 1
    own = F.when(first, F.col("record_id")).otherwise(F.concat(F.lit("<urn:segment:"), F.col("k"), F.lit(":"), F.substring("record_id", 2, 64)))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", own),
        F.lit(f"WARC-Date: {DATE}{CRLF}"),
        line("WARC-Target-URI", F.when(first, F.regexp_replace("url", r"[\r\n]", "%0A"))),
        line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("digest")))),
        line("X-Payload-Length", F.when(first, F.col("n"))),
        line("X-Page-ID", F.when(first, F.col("key"))),
        line("X-Refers-To-Page-ID", F.when(first, F.col("refers_to"))),
        line("WARC-Segment-Number", F.when(F.col("count") > 1, F.col("k"))),
        line("WARC-Segment-Origin-ID", F.when(~first, F.col("record_id"))),
        line("WARC-Segment-Total-Length", F.when(~first & (F.col("k") == F.col("count")), F.col("length"))),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        line("Content-Length", F.octet_length("piece")),
        F.lit(CRLF),
    )
    return parts.select(F.concat(head, F.col("piece").cast("string")).alias("record"))


def write_archives(df: DataFrame, folder: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, per_file: int = FILE_RECORDS) -> None:
    """Write the rows as gzip archives; Spark's own commit keeps files of lost attempts out.

    The line separator of the text sink is the record separator of the format.
    """
    made = records(with_roles(df), segment, chunk)
    made.write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(folder)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one after another."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield head, block


def decode_block(block: bytes) -> bytes:
    """Payload of an HTTP block; chunked framing is undone, and must end with its zero chunk."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(part)
        at = end + 4 + size


_RAW = (
    "record_id string, kind string, page_id string, url string, digest string, declared bigint, refers_to string, "
    "segment int, origin string, total bigint, block binary"
)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives in ``folder``, segments apart; a task reads one file at a time."""
    ship_package(spark)
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([pa.field(f.split()[0], kinds[f.split()[1]]) for f in _RAW.split(", ")])

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def run(batches):
        rows: list[tuple] = []
        held = 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for content in batch.column(0):
                with gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())) as raw:
                    for h, block in parse(io.BufferedReader(raw, 1 << 16)):
                        get = h.get
                        digest = get("warc-payload-digest")
                        rows.append(
                            (
                                get("warc-record-id"),
                                get("warc-type"),
                                get("x-page-id"),
                                get("warc-target-uri"),
                                digest and digest.partition(":")[2],
                                number(get("x-payload-length")),
                                get("x-refers-to-page-id"),
                                number(get("warc-segment-number")),
                                get("warc-segment-origin-id"),
                                number(get("warc-segment-total-length")),
                                block,
                            )
                        )
                        held += len(block)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield full()
                            rows.clear()
                            held = 0
        if rows:
            yield full()

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, _RAW)


def reassemble(raw: DataFrame) -> DataFrame:
    """One row per record, its segments joined: ``block`` is null and ``error`` set where a segment or length is wrong.

    Whole records pass without a shuffle; only segments are grouped, by their origin, and
    a group is one record.
    """
    whole = raw.where("segment is null").withColumn("error", F.lit(None).cast("string"))
    parts = raw.where("segment is not null").withColumn("key", F.coalesce("origin", "record_id"))
    firsts = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("key").agg(
        *[firsts(c) for c in ("kind", "page_id", "url", "digest", "declared", "refers_to")],
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("pieces"),
    )
    numbers = F.transform("pieces", lambda p: p["segment"])
    block = F.array_join(F.transform("pieces", lambda p: p["block"].cast("string")), "").cast("binary")
    right = F.coalesce(
        (numbers == F.sequence(F.lit(1), F.size("pieces"))) & (F.octet_length("joined") == F.col("total")), F.lit(False)
    )
    made = joined.withColumn("joined", block).select(
        F.col("key").alias("record_id"),
        "kind",
        "page_id",
        "url",
        "digest",
        "declared",
        "refers_to",
        F.when(right, F.col("joined")).alias("block"),
        F.when(~right, F.lit("segments do not make up the record")).alias("error"),
    )
    return whole.select(made.columns).unionByName(made)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, kind, refers_to, payload, digest, n, error`` of every record.

    A revisit has no payload of its own; digest and n are those it declares.  A response's are
    computed from the payload, and a difference from what it declares is an error.
    """
    def decode(blocks, kinds):
        payloads, errors = [], []
        for block, kind in zip(blocks, kinds):
            payload = error = None
            if kind != "revisit" and block is not None:
                try:
                    payload = decode_block(block)
                except ValueError as e:
                    error = str(e)
            payloads.append(payload)
            errors.append(error)
        return payloads, errors

    read = append(reassemble(read_records(spark, folder)), ["block", "kind"], decode, "payload binary, bad_block string")
    revisit = F.col("kind") == "revisit"
    digest = F.when(revisit, F.col("digest")).otherwise(F.sha2("payload", 256))
    n = F.when(revisit, F.col("declared")).otherwise(F.octet_length("payload").cast("long"))
    differs = F.when((digest != F.col("digest")) | (n != F.col("declared")), F.lit("payload differs from its digest"))
    return read.select(
        "page_id", "url", "kind", "refers_to", "payload", digest.alias("digest"), n.alias("n"), F.coalesce("error", "bad_block", differs).alias("error")
    )
