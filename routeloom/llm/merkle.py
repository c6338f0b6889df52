"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

Sections are parted by blank lines, paragraphs by line ends.  A paragraph's hash
covers its exact text, a section's the hashes of its paragraphs, the root's those of
the sections, all in full: equal roots mean equal texts.  Branches are told by short hashes.
Leaves below a paragraph say how much of a changed one is left.  They are cut by content:
where a rolling hash of the last characters meets a rule, so that leaves line up again
behind an edit, with or without blanks in the text.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from routeloom.llm.common import append
from routeloom.session import ship_package

#: Characters that decide a cut, its mean distance, and the shortest and longest leaf.
WINDOW, DISTANCE, SHORTEST, LONGEST = 4, 20, 6, 96
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _hash(parts: list[bytes]) -> str:
    return hashlib.sha256(b"".join(len(p).to_bytes(8, "little") + p for p in parts)).hexdigest()


def _cuts(codes: np.ndarray) -> np.ndarray:
    """Places behind characters that end a leaf; what stands before a line's start does not count."""
    mixed = (codes + np.uint32(1)) * _FACTORS[0]
    line_end = codes == 10
    same_line = np.ones(len(codes), bool)
    for back in range(1, min(WINDOW, len(codes))):
        same_line[back:] &= ~line_end[: len(codes) - back]
        mixed[back:] += np.where(same_line[back:], (codes[: len(codes) - back] + np.uint32(1)) * _FACTORS[back], np.uint32(0))
    mixed ^= mixed >> np.uint32(15)
    return np.flatnonzero(mixed % np.uint32(DISTANCE) == 0) + 1


def _spans(start: int, stop: int, marks: list[int], at: int) -> tuple[list[tuple[int, int]], int]:
    """Leaves of the line ``[start, stop)`` as spans, and the next mark to look at."""
    out = []
    while True:
        while at < len(marks) and marks[at] <= start:
            at += 1
        end = min(marks[at], stop) if at < len(marks) else stop
        while end - start > LONGEST:
            out.append((start, start + LONGEST))
            start += LONGEST
        if end - start >= SHORTEST or end == stop:
            if end > start:
                out.append((start, end))
            start = end
        if end == stop:
            return out, at
        at += 1


def leaves(line: str) -> list[str]:
    """A paragraph cut by content; its leaves joined are the paragraph."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    return [line[a:b] for a, b in _spans(0, len(line), _cuts(codes).tolist() if line else [], 0)[0]]


def tree(text: str | None) -> tuple:
    """(root, [(section, [(paragraph, [leaf, ...]), ...]), ...]); an empty text has a root only."""
    if not text:
        return _hash([]), []
    raw = text.encode("utf-32-le", "surrogatepass")
    marks, view = _cuts(np.frombuffer(raw, "<u4")).tolist(), memoryview(raw)
    short = xxhash.xxh32_hexdigest
    sections, full = [], []
    start = at = 0
    for part in text.split("\n\n"):
        whole, paragraphs = [], []
        for line in part.split("\n"):
            spans, at = _spans(start, start + len(line), marks, at)
            whole.append(hashlib.sha256(line.encode("utf-8", "surrogatepass")).hexdigest())
            paragraphs.append((whole[-1][:16], [short(view[4 * a : 4 * b]) for a, b in spans]))
            start += len(line) + 1
        start += 1
        full.append(_hash([p.encode() for p in whole]))
        sections.append((full[-1][:16], paragraphs))
    return _hash([s.encode() for s in full]), sections


def dump(node: tuple) -> str:
    """root;section(paragraph:leaves,...)... — short hashes joined without gaps."""
    root, sections = node
    return root + "".join(f";{s}(" + ",".join(p + ":" + "".join(r) for p, r in ps) + ")" for s, ps in sections)


def load(text: str) -> tuple:
    root, *sections = text.split(";")
    out = []
    for s in sections:
        name, _, rest = s[:-1].partition("(")
        ps = [p.partition(":") for p in rest.split(",")]
        out.append((name, [(p, [r[k : k + 8] for k in range(0, len(r), 8)]) for p, _, r in ps]))
    return root, out


def _differing(a: list[tuple], b: list[tuple]) -> tuple[list, list]:
    """Branches of each side that the other lacks (as often)."""
    left, right = Counter(h for h, _ in a), Counter(h for h, _ in b)
    out = []
    for side, other in ((a, right), (b, left)):
        spare = Counter(other)
        kept = []
        for k, (h, below) in enumerate(side):
            if spare[h] > 0:
                spare[h] -= 1
            else:
                kept.append((k, h, below))
        out.append(kept)
    return out[0], out[1]


def _size(sections: list) -> int:
    return sum(len(r) for _, ps in sections for _, r in ps)


def likeness(a: tuple, b: tuple) -> float:
    """1 for equal roots; else twice the common leaves over all leaves, descending into differing branches only."""
    if a[0] == b[0]:
        return 1.0
    total = _size(a[1]) + _size(b[1])
    if not total:
        return 0.0
    left, right = _differing(a[1], b[1])
    changed = sum(_size([(h, ps)]) for _, h, ps in left)
    common = _size(a[1]) - changed
    paragraphs = _differing([p for _, _, ps in left for p in ps], [p for _, _, ps in right for p in ps])
    lost = [sum(len(r) for _, _, r in side) for side in paragraphs]
    common += changed - lost[0]
    runs = [Counter(x for _, _, r in side for x in r) for side in paragraphs]
    common += (runs[0] & runs[1]).total()
    return min(2.0 * common / total, 1.0)


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of the first fingerprint whose branch the second lacks."""
    x, y = load(a), load(b)
    if x[0] == y[0]:
        return []
    left, right = _differing(x[1], y[1])
    have = Counter(p for _, _, ps in right for p, _ in ps)
    out = []
    for k, _, ps in left:
        for j, (p, _) in enumerate(ps):
            if have[p] > 0:
                have[p] -= 1
            else:
                out.append((k, j))
    return out


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``fingerprint``; a null text counts as empty."""
    return append(df, [text], lambda texts: [[dump(tree(t)) for t in texts]], "fingerprint string")


def with_next(df: DataFrame, key: str, text: str, ranges: int | None = None) -> DataFrame:
    """``key, text, next_text``: each row's text and that of the row after it by ``key``; the last takes the first.

    ``key`` is a whole number; rows of equal key follow each other by text hash, null keys
    come first, null texts count as empty.  Texts are shuffled once, into key ranges; the
    first row of a range is also sent to the range before it, so that no row waits for
    another task.  Only one key per range reaches the driver.
    """
    spark = df.sparkSession
    ship_package(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    base = base.withColumn("h", F.xxhash64("t"))
    cuts = base.select("k").stat.approxQuantile("k", [j / ranges for j in range(1, ranges)], 0.2 / ranges)
    bounds = np.array(sorted({int(c) for c in cuts}), dtype="i8")

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        known = k.notna()
        return pd.Series(np.searchsorted(bounds, k.where(known, 0).astype("i8"), side="right")).where(known.values, 0).astype("int32")

    placed = base.withColumn("r", range_of("k"))
    firsts = (
        placed.groupBy("r").agg(F.min(F.struct(F.col("k").isNotNull().alias("s"), "k", "h")).alias("f")).orderBy("r").collect()
    )
    if not firsts:
        return df.sparkSession.createDataFrame([], f"`{key}` bigint, `{text}` string, next_text string")
    # the first row of each range goes to the range before it as well
    goes = [(f["f"]["k"], f["f"]["h"], firsts[j - 1]["r"]) for j, f in enumerate(firsts)]
    sent = spark.createDataFrame(goes, "ck bigint, ch bigint, cr int")
    copies = (
        placed.join(F.broadcast(sent), F.col("k").eqNullSafe(F.col("ck")) & (F.col("h") == F.col("ch")))
        .select("k", "t", "h", F.col("cr").alias("r"))
        .withColumn("copy", F.lit(True))
    )
    both = placed.select("k", "t", "h", "r").withColumn("copy", F.lit(False)).unionByName(copies)
    ordered = both.repartition(ranges, "r").sortWithinPartitions("r", "copy", F.asc_nulls_first("k"), "h")

    schema = pa.schema([("k", pa.int64()), ("t", pa.string()), ("next_text", pa.string())])

    def follow(batches):
        held = None  # (k, text, range), waiting for the row after it
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: tuple[list, list, list] = ([], [], [])
                for k, t, r, copy in zip(*[part.column(c).to_pylist() for c in ("k", "t", "r", "copy")]):
                    if held is not None and held[2] == r:
                        for c, v in zip(out, (held[0], held[1], t)):
                            c.append(v)
                    held = None if copy else (k, t, r)
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(out, schema)], schema=schema)

    done = ordered.select("k", "t", "r", "copy").mapInArrow(follow, "k bigint, t string, next_text string")
    return done.select(F.col("k").alias(key), F.col("t").alias(text), "next_text")


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (later half from the next document), and their likeness."""

    def run(texts, nexts):
        out: tuple[list, ...] = ([], [], [], [], [], [])
        before, known = None, None  # the next text of a row is mostly the text of the row after it
        for t, n in zip(texts, nexts):
            half = len(t) // 2
            edited = t[: len(t) - half] + n[:half]
            own = known if t == before else tree(t)
            changed, following = tree(edited), tree(n)
            before, known = n, following
            row = (len(t), edited, dump(own), dump(changed), likeness(own, changed), likeness(own, following))
            for c, v in zip(out, row):
                c.append(v)
        return out

    pairs = with_next(df, key, text)
    schema = "n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return append(pairs, [text, "next_text"], run, schema)
