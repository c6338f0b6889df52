"""Hard negatives by exact inner-product search with coordinate pruning.

Rows are sorted by length and cut into buckets of similar length.  A bucket holds, for
every coordinate, its rows' unit components in order.  An anchor that looks for scores of
at least ``t`` needs a cosine of at least ``c = t / (|q| * longest row)``; for each of its
focus coordinates (its largest components) that leaves a range of feasible values, found in
the sorted list by two binary searches.  Rows in all ranges are verified by their exact
integer scores, so pruning never changes a result.  Buckets whose longest row is too short
are skipped.  ``t`` rises as better rows are found.

Every task holds a bounded run of rows and reads the anchors block by block from a table
in the shared folder; it returns at most ``k`` rows for each anchor and interval.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from routeloom.llm.common import begin
from routeloom.session import cut_lineage, forget_later, shared_dir, ship_package

BUCKET_ROWS = 2048
GROUP_ROWS = 1 << 15
ANCHOR_ROWS = 1024
FOCUS = 4
#: An anchor whose shortest range leaves more than this share of a bucket takes all of its rows.
DENSE = 0.25
SLACK = 1e-9


class Bucket:
    """Rows of similar length, by id, and their unit components sorted per coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.values = ids[by_id], labels[by_id], values[by_id]
        lengths = np.sqrt((self.values**2).sum(1))
        self.longest = float(lengths.max())
        self.unit = self.values / np.where(lengths > 0, lengths, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0).astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.unit, self.order, 0).T)


class Anchors:
    """A block of anchors with the score intervals they look for: ``low`` and ``high`` are (anchor, interval)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.ids, self.labels, self.values, self.low, self.high, self.k = ids, labels, values, low, high, k
        self.lengths = np.sqrt((values**2).sum(1))
        unit = values / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        self.angle = np.arccos(np.clip(np.take_along_axis(unit, self.focus, 1), -1, 1))
        shape = (*low.shape, k)
        self.score, self.found = np.full(shape, -np.inf), np.zeros(shape, np.int64)

    def least(self) -> np.ndarray:
        """The score that a row must reach to enter, per anchor and interval."""
        return np.maximum(self.low, self.score[:, :, -1])

    def ranges(self, bucket: Bucket, bound: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Anchors that take all rows of the bucket, and the feasible rows of the others."""
        m = len(bucket.ids)
        reach = self.lengths * bucket.longest
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(bound > 0, np.where(reach > 0, bound / reach, np.inf), -1.0)
        alive = cosine <= 1 + SLACK
        pruned = np.flatnonzero(alive & (cosine > 0))
        if not len(pruned) or not self.focus.shape[1]:
            return np.flatnonzero(alive), {}
        gap = np.arccos(np.clip(cosine[pruned], -1, 1))[:, None]
        low = np.cos(np.minimum(np.pi, self.angle[pruned] + gap)) - SLACK
        high = np.cos(np.maximum(0.0, self.angle[pruned] - gap)) + SLACK
        begin_at, end_at = np.zeros(low.shape, np.int64), np.zeros(low.shape, np.int64)
        focus = self.focus[pruned]
        for f in np.unique(focus):
            here = focus == f
            begin_at[here] = np.searchsorted(bucket.sorted[f], low[here], "left")
            end_at[here] = np.searchsorted(bucket.sorted[f], high[here], "right")
        count = end_at - begin_at
        best = count.argmin(1)
        few = count[np.arange(len(pruned)), best] <= DENSE * m
        sparse: dict[int, np.ndarray] = {}
        for p in np.flatnonzero(few):
            f = focus[p, best[p]]
            rows = bucket.order[begin_at[p, best[p]] : end_at[p, best[p]], f]
            for g in range(focus.shape[1]):
                x = bucket.unit[rows, focus[p, g]]
                rows = rows[(x >= low[p, g]) & (x <= high[p, g])]
            if len(rows):
                sparse[int(pruned[p])] = np.sort(rows)
        rest = np.ones(len(self.ids), bool)
        rest[pruned[few]] = False
        return np.flatnonzero(alive & rest), sparse

    def search(self, bucket: Bucket, same: bool) -> None:
        """Take the bucket's rows of the same label (or of other labels) that lie in an interval."""
        least = self.least()
        dense, sparse = self.ranges(bucket, least.min(1))
        hits: list[tuple] = []
        parts = [(dense[at : at + 256], None) for at in range(0, len(dense), 256)]
        parts += [(np.array([a]), rows) for a, rows in sparse.items()]
        for which, rows in parts:
            values, ids, labels = bucket.values, bucket.ids, bucket.labels
            if rows is not None:
                values, ids, labels = values[rows], ids[rows], labels[rows]
            scores = self.values[which] @ values.T
            allowed = (self.labels[which][:, None] == labels[None, :]) == same
            allowed &= self.ids[which][:, None] != ids[None, :]
            for i in range(least.shape[1]):
                ok = allowed & (scores >= least[which, i][:, None]) & (scores <= self.high[which, i][:, None])
                if scores.shape[1] > self.k and ok.any():
                    part = np.where(ok, scores, -np.inf)
                    ok &= scores >= np.partition(part, -self.k, axis=1)[:, [-self.k]]
                a, r = np.nonzero(ok)
                hits.append((which[a] * least.shape[1] + i, scores[a, r], ids[r]))
        if hits:
            self._merge(*[np.concatenate(x) for x in zip(*hits)])

    def _merge(self, slot: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        if not len(slot):
            return
        old_slot, old_place = np.nonzero(np.isfinite(self.score.reshape(-1, self.k)))
        slot = np.concatenate([old_slot, slot])
        score = np.concatenate([self.score.reshape(-1, self.k)[old_slot, old_place], score])
        found = np.concatenate([self.found.reshape(-1, self.k)[old_slot, old_place], found])
        order = np.lexsort((found, -score, slot))
        slot, score, found = slot[order], score[order], found[order]
        first = np.searchsorted(slot, slot, "left")
        place = np.arange(len(slot)) - first
        keep = place < self.k
        self.score.reshape(-1, self.k)[slot[keep], place[keep]] = score[keep]
        self.found.reshape(-1, self.k)[slot[keep], place[keep]] = found[keep]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Bucket]]:
    """Consecutive rows of one dimension, at most ``GROUP_ROWS``, as buckets."""
    held: list[pa.RecordBatch] = []
    count, dim = 0, None

    def close():
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        out = []
        for at in range(0, table.num_rows, BUCKET_ROWS):
            part = table.slice(at, BUCKET_ROWS)
            out.append(Bucket(part.column(1).to_numpy(), part.column(2).to_numpy(), _matrix(part.column(3), part.num_rows)))
        return out

    for batch in batches:
        dims = batch.column(0).to_numpy()
        at = 0
        while at < len(dims):
            if held and (dims[at] != dim or count >= GROUP_ROWS):
                yield close()
                held, count = [], 0
            dim = dims[at]
            end = min(at + GROUP_ROWS - count, at + int(np.searchsorted(dims[at:], dim, "right")))
            held.append(batch.slice(at, end - at))
            count, at = count + end - at, end
    if held:
        yield close()


def _blocks(folder: str, dim: int, k: int) -> Iterator[Anchors]:
    """The anchors of one dimension, in blocks, from the files in ``folder``."""
    store, root = fs.FileSystem.from_uri(folder)
    for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda x: x.path):
        if not info.path.endswith(".parquet"):
            continue
        with store.open_input_file(info.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(ANCHOR_ROWS):
                batch = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                n = batch.num_rows
                if n:
                    ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
                    low, high = _matrix(batch.column("low"), n), _matrix(batch.column("high"), n)
                    yield Anchors(ids, labels, _matrix(batch.column("v"), n), low, high, k)


def _best(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor, part, rank, score, found``: the first ``k`` rows in each interval of each anchor."""
    spark = rows.sparkSession
    ship_package(spark)
    folder = f"{shared_dir(spark)}/anchors-{uuid.uuid4().hex}"
    anchors.select("id", "label", "dim", "v", "low", "high").write.parquet(folder)
    forget_later(folder)
    schema = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("score", pa.int64()), ("found", pa.int64())])

    def run(batches):
        begin(__name__)
        for buckets in _groups(batches):
            longest = max(b.longest for b in buckets)
            for block in _blocks(folder, buckets[0].values.shape[1], k):
                if longest * block.lengths.max() >= 2.0**53:
                    raise ValueError("components are too large for exact scores")
                for bucket in buckets:
                    block.search(bucket, same)
                a, i, p = np.nonzero(np.isfinite(block.score))
                if len(a):
                    columns = [block.ids[a], i.astype(np.int32), block.score[a, i, p].astype(np.int64), block.found[a, i, p]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    found = rows.select("dim", "id", "label", "v").mapInArrow(run, "anchor bigint, part int, score bigint, found bigint")
    place = F.row_number().over(Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(
    df: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vec: str = "v",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vec`` is an array of integers and a score an exact inner product; higher scores come
    first, ties by smaller key.  Each anchor's positives are its first other rows of the same
    label.  Negatives of an anchor and a positive are the first rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    Rows with a null key, label, vector or component take no part; an empty vector scores 0.
    Vectors are only compared with others of their dimension.  A key given more than once
    counts once, with its least (label, vector).  An empty table gives no rows, and so does
    an anchor without positives.  Other columns are not read.  Scores of 2**53 and more end
    the run with an error.
    """
    chosen = df.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vec}`").cast("array<bigint>").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where("id is not null and label is not null and v is not null and forall(v, x -> x is not null)")
    once = chosen.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("anchor").alias("anchor"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    flat = once.select("id", "r.label", "r.v", "anchor", F.size("r.v").alias("dim"), length.alias("length"))
    rows = cut_lineage(flat.repartitionByRange("dim", F.desc("length"), "id").sortWithinPartitions("dim", F.desc("length"), "id"))

    infinite = F.lit(float("inf"))
    asking = rows.where("anchor")
    first = _best(rows, asking.withColumns({"low": F.array(-infinite), "high": F.array(infinite)}), positives, True)
    first = cut_lineage(first.select("anchor", F.col("rank").alias("part"), F.col("score").alias("positive_score"), F.col("found").alias("positive_id")))

    scores = first.groupBy(F.col("anchor").alias("id")).agg(F.array_sort(F.collect_list(F.struct("part", "positive_score"))).alias("p"))
    reach = asking.join(scores, "id").select(
        "id",
        "label",
        "dim",
        "v",
        # a part without a positive has an empty interval
        F.expr(f"transform(sequence(1, {positives}), i -> if(i > size(p), double('inf'), double(ceil(p[i - 1].positive_score * {low} / 100BD))))").alias("low"),
        F.expr(f"transform(sequence(1, {positives}), i -> if(i > size(p), double('-inf'), double(floor(p[i - 1].positive_score * {high} / 100BD))))").alias("high"),
    )
    second = _best(rows, reach, negatives, False).withColumn("part", F.col("part") + 1)
    return second.join(first, ["anchor", "part"]).select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("found").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
