"""Near duplicates among vectors by NN-descent.

A neighbour graph is started from random projections and refined: the neighbours of a node,
and the nodes that list it, are introduced to each other, and everyone keeps the nearest
``k`` it has met.  Only pairs with a new member are compared.  A node whose whole list lies
within the threshold is saturated: its list is doubled and its neighbours meet again.  The
graph is audited against a brute-force search for a bounded sample of nodes and refined from
further projections while recall is low.  Edges within the threshold are then checked in
double precision.

Copies are not expanded into pairs.  Equal vectors are one node that knows its row count.
Where lists are saturated, groups are drawn together: nodes within half of the threshold
angle of their group's mean are a ball, in which all are linked for certain.  A ball is a
single node with a radius; distances between nodes are the least that their members can
have.  Two balls whose farthest members are still within the threshold are linked as a whole,
pairs of balls in doubt are compared member by member, in blocks that return only counts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from routeloom.llm.common import begin, components, distribute, local_path
from routeloom.session import cut_lineage, ship_package

NEIGHBOURS = 10
TREES = 3
BITS = 24
BLOCK = 256
REVERSE_CHUNK = 64
ROUNDS = 12
SETTLED = 0.001
AUDIT_NODES = 2048
AUDITS = 3
RECALL = 0.97
MEMBER_CHUNK = 512
#: Angles from single precision; every accepted link is checked in double precision.
LOOSE = 2e-3

POINT = "node long, label long, dim int, r double, v binary, codes array<bigint>"
LINK = "u long, v long, gap double, k int"


def _unit32(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(n, -1)


def _gaps(v: np.ndarray, r: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Least angle that members of two nodes can have, for all pairs."""
    return np.arccos(np.clip(v @ w.T, -1, 1)) - r[:, None] - s[None, :]


def points(df: DataFrame, seed: int) -> DataFrame:
    """``POINT`` rows of (node, label, r, vec): unit vectors in single precision and projection codes."""
    ship_package(df.sparkSession)
    schema = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("r", pa.float64()), ("v", pa.binary()), ("codes", pa.list_(pa.int64()))])

    def run(batches):
        begin(__name__)
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(3).value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                flat = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim)
                unit = (flat / np.sqrt((flat**2).sum(1))[:, None]).astype("<f4")
                if dim not in planes:
                    planes[dim] = np.random.RandomState(seed).standard_normal((dim, TREES * BITS)).astype(np.float32)
                bits = (unit @ planes[dim] > 0).reshape(len(unit), TREES, BITS)
                codes = (bits * (1 << np.arange(BITS - 1, -1, -1))).sum(2)
                columns = [part.column(0), part.column(1), pa.array(np.full(len(unit), dim, np.int32)), part.column(2)]
                columns += [pa.array([x.tobytes() for x in unit], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.select("node", "label", "r", "vec").mapInArrow(run, POINT)


def _offers(gap: np.ndarray, ids: np.ndarray, k: np.ndarray, bound: np.ndarray, theta: float) -> tuple[np.ndarray, ...] | None:
    """Of a block's pairs (inf: none), the nearest ``k`` of each row that its list has room for."""
    most = int(k.max())
    if gap.shape[1] > most:
        kth = np.partition(gap, most - 1, axis=1)[:, most - 1]
        bound = np.minimum(bound, np.maximum(kth, -9))
    a, b = np.nonzero(gap <= np.minimum(np.maximum(bound, theta), 9)[:, None])
    if not len(a):
        return None
    order = np.lexsort((ids[b], gap[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a, "left")
    keep = place < k[a]
    return a[keep], b[keep]


def projected(nodes: DataFrame, theta: float, k: int) -> DataFrame:
    """``LINK`` rows: the nearest nodes within blocks of rows that are next to each other in a projection."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("gap", pa.float64()), ("k", pa.int32())])

    def run(batches):
        begin(__name__)
        for part in _runs(batches, 2, BLOCK):
            n = part.num_rows
            if n < 2:
                continue
            ids, r, v = part.column(2).to_numpy(), part.column(3).to_numpy(), _unit32(part.column(4), n)
            gap = _gaps(v, r, v, r)
            np.fill_diagonal(gap, np.inf)
            found = _offers(gap, ids, np.full(n, k), np.full(n, 9.0), theta)
            if found:
                a, b = found
                columns = [ids[a], ids[b], gap[a, b].astype(np.float64), np.full(len(a), k, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    trees = []
    for t in range(TREES):
        one = nodes.select("label", "dim", "node", "r", "v", F.col("codes")[t].alias("code"))
        dealt = one.repartitionByRange("label", "dim", "code", "node").sortWithinPartitions("label", "dim", "code", "node")
        trees.append(dealt.drop("code").mapInArrow(run, LINK))
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Sorted rows as runs of equal first ``keys`` columns, joined over batches; cut at ``most`` rows."""
    held: list[pa.RecordBatch] = []
    count, last = 0, None

    def close():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in itertools.pairwise(cuts):
            key = tuple(c[s] for c in columns)
            if held and key != last:
                yield close()
                held, count = [], 0
            last = key
            while s < e:
                size = e - s if most is None else min(e - s, most - count)
                held.append(batch.slice(s, size))
                s, count = s + size, count + size
                if count == most:
                    yield close()
                    held, count = [], 0
    if held:
        yield close()


def _nearest(links: DataFrame) -> DataFrame:
    """One row for each (u, v), and of those the first k of each u; a known link stays known."""
    most = links.agg(F.max("k").alias("k")).first()["k"] or 1
    once = links.groupBy("u", "v").agg(F.min("gap").alias("gap"), F.max("k").alias("k"), F.min("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("u").orderBy("gap", "v"))
    first = once.withColumn("place", place).where((F.col("place") <= most) & (F.col("place") <= F.col("k")))
    return first.select("u", "v", "gap", "k", "new")


def _state(links: DataFrame, theta: float) -> DataFrame:
    """Per node its list's size, bound and whether it is saturated."""
    found = links.groupBy("u").agg(
        F.max("k").alias("k"), F.count(F.lit(1)).alias("n"), F.max("gap").alias("far"), F.sum((F.col("gap") <= theta).cast("int")).alias("near")
    )
    full = F.col("near") >= F.col("k")
    return found.select(
        F.col("u").alias("node"), "k", F.when(F.col("n") < F.col("k"), 9.0).otherwise(F.col("far")).alias("bound"), full.alias("full")
    )


def start(nodes: DataFrame, theta: float, k: int) -> DataFrame:
    """The graph that projections give, all of it new."""
    return cut_lineage(_nearest(projected(nodes, theta, k).withColumn("new", F.lit(True))))


def balls(classes: DataFrame, nodes: DataFrame, links: DataFrame, theta: float, link: float) -> tuple[DataFrame, DataFrame] | None:
    """Members (``ball, node``) and balls (``ball, label, r, vec``) drawn from saturated lists.

    Which nodes are drawn together decides work only: a member must lie within half of
    ``theta`` of the mean of its group, whatever the group is.
    """
    full = cut_lineage(_state(links, theta).where("full").select(F.col("node").alias("u")))
    if full.isEmpty():
        return None
    near = links.where(F.col("gap") <= link).join(full, "u", "left_semi").select("u", "v")
    loose = nodes.where("r = 0").select("node")
    both = near.union(near.select("v", "u")).distinct()
    both = both.join(loose.select(F.col("node").alias("u")), "u", "left_semi").join(loose.select(F.col("node").alias("v")), "v", "left_semi")
    both = cut_lineage(both)
    groups = both.select(F.col("u").alias("node")).distinct().withColumn("grp", F.col("node"))
    for _ in range(3):
        met = both.join(groups, F.col("v") == F.col("node")).groupBy("u").agg(F.min("grp").alias("m"))
        groups = cut_lineage(groups.join(met.withColumnRenamed("u", "node"), "node", "left").select("node", F.least("grp", "m").alias("grp")))
    sized = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("grp")
    placed = groups.join(sized, "grp").join(classes.select("node", "label", "unit"), "node")
    dims = placed.select("grp", "label", F.posexplode("unit").alias("i", "x")).groupBy("grp", "label", "i").agg(F.avg("x").alias("x"))
    means = dims.groupBy("grp", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    means = means.withColumn("len", length).where("len > 0").select("grp", "label", F.transform("mean", lambda x: x / F.col("len")).alias("vec"))
    angle = F.acos(F.least(F.lit(1.0), _dot("unit", "vec")))
    core = placed.join(means.select("grp", "vec"), "grp").withColumn("angle", angle).where(F.col("angle") <= theta / 2 - 1e-6)
    core = cut_lineage(core.select("grp", "node", "angle"))
    sizes = core.groupBy("grp").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    # a ball's number is its group's, turned negative so that it is no node's
    made = cut_lineage(sizes.join(means, "grp").select((-1 - F.col("grp")).alias("ball"), "label", (F.col("r") + 1e-7).alias("r"), "vec"))
    members = cut_lineage(core.select((-1 - F.col("grp")).alias("ball"), "node").join(made.select("ball"), "ball", "left_semi"))
    return None if made.isEmpty() else (members, made)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _introduce(links: DataFrame, nodes: DataFrame, state: DataFrame, theta: float) -> DataFrame:
    """``LINK`` rows: pairs that meet at a common neighbour, as far as their lists have room."""
    forward = links.select(F.col("u").alias("w"), F.col("v").alias("m"), "new", F.lit(0).alias("back"))
    listed = links.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / REVERSE_CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int")
    back = links.join(listed, "v").select(F.col("v").alias("w"), F.col("u").alias("m"), "new", chunk.alias("chunk"))
    # a node that very many list meets them in chunks, each with the node's whole list
    spread = listed.select(F.col("v").alias("w"), "chunks")
    self_ = state.select(F.col("node").alias("w"), F.col("node").alias("m"), F.lit(False).alias("new"), F.lit(0).alias("back"))
    ahead = forward.unionByName(self_).join(spread, "w", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    meets = ahead.select("w", "chunk", "m", "new").unionByName(back.select("w", "chunk", "m", "new"))
    once = meets.groupBy("w", "chunk", "m").agg(F.max("new").alias("new"))
    lively = cut_lineage(once.withColumn("any", F.max("new").over(Window.partitionBy("w", "chunk"))).where("any").drop("any"))
    told = nodes.join(state, "node").select(F.col("node").alias("m"), "r", "k", "bound", F.col("v").alias("vec"))
    rows = lively.join(told, "m").select("w", "chunk", "m", "new", "r", "k", "bound", "vec")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("gap", pa.float64()), ("k", pa.int32())])

    def run(batches):
        begin(__name__)
        held: list[tuple] = []
        size = 0

        def flush():
            made = [np.concatenate(x) for x in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], schema=schema)

        for part in _runs(batches, 2, None):
            n = part.num_rows
            ids, new = part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False)
            r, k, bound = (part.column(c).to_numpy() for c in (4, 5, 6))
            v = _unit32(part.column(7), n)
            gap = _gaps(v, r, v, r)
            gap[~(new[:, None] | new[None, :])] = np.inf
            np.fill_diagonal(gap, np.inf)
            found = _offers(gap, ids, k, bound, theta)
            if found:
                a, b = found
                held.append((ids[a], ids[b], gap[a, b].astype(np.float64), k[a].astype(np.int32)))
                size += len(a)
                if size > 20_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.repartition("w", "chunk").sortWithinPartitions("w", "chunk", "m").mapInArrow(run, LINK)


def refine(links: DataFrame, nodes: DataFrame, theta: float) -> DataFrame:
    """NN-descent from ``links`` until no list is saturated and a round changes next to nothing, or finds no edge within ``theta``."""
    total = nodes.count()
    for _ in range(ROUNDS):
        state = cut_lineage(_state(links, theta))
        grown = state.where("full").select(F.col("node").alias("u"))
        # a saturated list is doubled, and its neighbours meet again as if new
        larger = links.join(grown.withColumn("more", F.lit(True)), "u", "left")
        links = cut_lineage(
            larger.select("u", "v", "gap", F.when(F.col("more"), F.col("k") * 2).otherwise(F.col("k")).alias("k"), (F.col("new") | F.coalesce("more", F.lit(False))).alias("new"))
        )
        state = state.select("node", F.when(F.col("full"), F.col("k") * 2).otherwise(F.col("k")).alias("k"), F.when(F.col("full"), 9.0).otherwise(F.col("bound")).alias("bound"))
        offered = _introduce(links, nodes, state, theta).withColumn("new", F.lit(True))
        links = cut_lineage(_nearest(links.withColumn("new", F.lit(False)).unionByName(offered)))
        fresh = links.where("new").agg(F.count(F.lit(1)).alias("all"), F.coalesce(F.sum((F.col("gap") <= theta).cast("int")), F.lit(0)).alias("near")).first()
        settled = fresh["all"] <= SETTLED * total * NEIGHBOURS or fresh["near"] == 0
        if settled and _state(links, theta).where("full").isEmpty():
            break
    return links


def audit(links: DataFrame, nodes: DataFrame, theta: float) -> float:
    """Share of the true edges of a bounded sample of nodes that the graph has."""
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDIT_NODES).select("node", "label", "dim", "r", "v").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, sample.schema) as out:
        out.write_table(sample)
    name = distribute(spark, sink.getvalue().to_pybytes(), "audit.arrow")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        begin(__name__)
        with pa.memory_map(local_path(name)) as source:
            asked = pa.ipc.open_stream(source).read_all().combine_chunks()
        groups: dict[tuple, list[int]] = {}
        for place, key in enumerate(zip(asked["label"].to_pylist(), asked["dim"].to_pylist())):
            groups.setdefault(key, []).append(place)
        pieces = {k: asked.take(pa.array(x)).combine_chunks().to_batches()[0] for k, x in groups.items()}
        for batch in batches:
            label, dim = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for key, piece in pieces.items():
                part = batch.filter(pa.array((label == key[0]) & (dim == key[1])))
                n = part.num_rows
                if not n:
                    continue
                ids = part.column(0).to_numpy()
                own = piece.column(0).to_numpy()
                gap = _gaps(_unit32(piece.column(4), len(own)), piece.column(3).to_numpy(), _unit32(part.column(4), n), part.column(3).to_numpy())
                a, b = np.nonzero((gap <= theta) & (own[:, None] != ids[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(ids[b])], schema=schema)

    true = nodes.select("node", "label", "dim", "r", "v").mapInArrow(run, "u long, v long")
    pairs = _pairs(links, theta).withColumn("hit", F.lit(1))
    sides = true.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    got = sides.join(pairs, ["a", "b"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hit")).first()
    return got["hit"] / got["n"] if got["n"] else 1.0


def _pairs(links: DataFrame, theta: float) -> DataFrame:
    return links.where(F.col("gap") <= theta).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def graph(nodes: DataFrame, links: DataFrame, theta: float, k: int = NEIGHBOURS) -> tuple[DataFrame, float]:
    """The refined neighbour graph and its audited recall; low recall brings further projections in."""
    recall = 0.0
    for extra in range(1, AUDITS + 1):
        links = refine(links, nodes, theta)
        recall = audit(links, nodes, theta)
        if recall >= RECALL or extra == AUDITS:
            break
        again = points_again(nodes, extra)
        links = cut_lineage(_nearest(links.unionByName(projected(again, theta, k).withColumn("new", F.lit(True)))))
    return links, recall


def points_again(nodes: DataFrame, seed: int) -> DataFrame:
    """The same nodes with codes of other projections."""
    schema = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("r", pa.float64()), ("v", pa.binary()), ("codes", pa.list_(pa.int64()))])

    def run(batches):
        begin(__name__)
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                unit = _unit32(part.column(4), part.num_rows)
                planes = np.random.RandomState(seed).standard_normal((dim, TREES * BITS)).astype(np.float32)
                bits = (unit @ planes > 0).reshape(len(unit), TREES, BITS)
                codes = (bits * (1 << np.arange(BITS - 1, -1, -1))).sum(2)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(codes.tolist(), pa.list_(pa.int64()))], schema=schema)

    return cut_lineage(nodes.select("node", "label", "dim", "r", "v", "codes").mapInArrow(run, POINT))


def _verify(doubtful: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """``a, b, node, links``: rows linked to each member across pairs of nodes in doubt."""
    ship_package(doubtful.sparkSession)
    sizes = members.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / MEMBER_CHUNK).cast("int").alias("chunks"))
    dealt = members.join(sizes, "ball").select("ball", "node", "unit", "n", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    chunks = lambda side: sizes.select(F.col("ball").alias(side), F.col("chunks").alias(f"n_{side}"))
    sized = doubtful.select("a", "b").join(chunks("a"), "a").join(chunks("b"), "b")
    blocks = sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
    key = ["a", "b", "i", "j"]
    left = blocks.select(*key, F.lit(0).alias("side"), F.col("a").alias("ball"), F.col("i").alias("chunk"))
    right = blocks.select(*key, F.lit(1).alias("side"), F.col("b").alias("ball"), F.col("j").alias("chunk"))
    rows = left.unionByName(right).join(dealt, ["ball", "chunk"]).select(*key, "side", "node", "n", "unit")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("node", pa.int64()), ("links", pa.int64())])

    def run(batches):
        begin(__name__)
        for part in _runs(batches, 4, None):
            side, n = part.column(4).to_numpy(), part.column(6).to_numpy()
            unit = part.column(7).flatten().to_numpy().reshape(part.num_rows, -1)
            linked = unit[side == 0] @ unit[side == 1].T >= cosine
            ids = part.column(5).to_numpy()
            both = np.concatenate([ids[side == 0], ids[side == 1]])
            links = np.concatenate([linked @ n[side == 1], linked.T @ n[side == 0]])
            keep = links > 0
            a, b = (np.full(int(keep.sum()), part.column(c)[0].as_py()) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(both[keep]), pa.array(links[keep])], schema=schema)

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long, node long, links long")


def near_vectors(df: DataFrame, cosine: float, key: str = "vec_id", label: str = "label", vec: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Rows link when their labels are equal and not null, their vectors have the same dimension
    and a cosine of at least ``cosine`` (above 0).  ``n_links`` counts linked rows, rows with
    the same key included; ``component_id`` is the smallest key reachable and ``kept`` tells
    whether it is the row's own.  Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing.  A row without a key links like others and is not
    kept; a component without keys has a null id.  An empty table gives no rows; other columns
    are not read.  The neighbour search is approximate: links may be missed (``graph`` audits
    the share), none is made up.
    """
    spark = df.sparkSession
    ship_package(spark)
    theta = math.acos(cosine)
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vec}`").alias("vec")
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    valid = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    # adding 0 makes -0.0 equal 0.0
    able = rows.where(valid).select("id", "label", F.transform("vec", lambda x: x + F.lit(0).cast("float")).alias("vec"))
    top = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    scaled = F.transform("vec", lambda x: x.cast("double") / F.col("top"))
    classes = able.groupBy("label", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("top", top)
    classes = classes.withColumn("s", scaled).withColumn("len", F.sqrt(F.aggregate("s", F.lit(0.0), lambda s, x: s + x * x)))
    classes = cut_lineage(
        classes.select(F.monotonically_increasing_id().alias("node"), "label", "vec", "least", "n", F.transform("s", lambda x: x / F.col("len")).alias("unit"))
    )

    nodes = cut_lineage(points(classes.select("node", "label", F.lit(0.0).alias("r"), F.col("unit").alias("vec")), seed=0))
    members = centres = None
    links = start(nodes, theta + LOOSE, k)
    for link in (theta, theta / 2):
        drawn = balls(classes, nodes, links, theta, link)
        if drawn is None:
            continue
        found, made = drawn
        members = found if members is None else members.unionByName(found)
        centres = made if centres is None else centres.unionByName(made)
        new = points(made.select(F.col("ball").alias("node"), "label", "r", "vec"), seed=0)
        nodes = cut_lineage(nodes.join(found.select("node"), "node", "left_anti").unionByName(new))
        links = start(nodes, theta + LOOSE, k)

    links, _ = graph(nodes, links, theta + LOOSE, k)

    # every node's members (a loose class is its own), sizes and exact vectors
    single = classes.select(F.col("node").alias("ball"), "node")
    if members is None:
        inside = single
        exact = classes.select("node", F.lit(0.0).alias("r"), F.col("unit").alias("vec"))
    else:
        inside = members.select("ball", "node").unionByName(single.join(members.select("node"), "node", "left_anti").select("ball", "node"))
        exact = classes.join(members.select("node"), "node", "left_anti").select("node", F.lit(0.0).alias("r"), F.col("unit").alias("vec"))
        exact = exact.unionByName(centres.select(F.col("ball").alias("node"), "r", "vec"))
    inside = cut_lineage(inside.join(classes.select("node", "unit", "n", "least"), "node"))
    totals = inside.groupBy("ball").agg(F.sum("n").alias("rows"), F.min("least").alias("least"))

    side = lambda s: exact.select(F.col("node").alias(s), F.col("r").alias(f"r_{s}"), F.col("vec").alias(f"vec_{s}"))
    checked = _pairs(links, theta + LOOSE).join(side("a"), "a").join(side("b"), "b").withColumn("dot", _dot("vec_a", "vec_b"))
    reach = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "dot"))) + F.col("r_a") + F.col("r_b")
    loose = (F.col("r_a") == 0) & (F.col("r_b") == 0)
    sure = F.when(loose, F.col("dot") >= cosine).otherwise(reach <= theta - 1e-6)
    checked = cut_lineage(checked.select("a", "b", loose.alias("loose"), sure.alias("sure")))
    certain = checked.where("sure").select("a", "b")
    counted = cut_lineage(_verify(checked.where("not sure and not loose"), inside, cosine))

    both = certain.unionByName(certain.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outward = both.join(totals.select(F.col("ball").alias("b"), "rows"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("rows").alias("outward"))
    more = counted.groupBy("node").agg(F.sum("links").alias("more"))
    edges = cut_lineage(certain.unionByName(counted.select("a", "b").distinct()))
    rooted = components(totals.select(F.col("ball").alias("id")), edges).join(totals.select(F.col("ball").alias("id"), "least"), "id")
    named = rooted.join(rooted.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(F.col("id").alias("ball"), "component_id")

    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    made = inside.select("ball", "node").join(totals.select("ball", "rows"), "ball").join(outward, "ball", "left").join(more, "node", "left").join(named, "ball")
    done = made.select("node", (F.col("rows") - 1 + zero("outward") + zero("more")).alias("n_links"), "component_id")
    told = classes.select("node", "label", "vec").join(done, "node").select("label", "vec", "n_links", "component_id")
    linked = able.join(told, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", kept)
