"""N-gram Jaccard join with signature trees.

1. Every text becomes the set of its word n-grams (64-bit hashes).  Equal sets are one
   class, known by its fingerprint; copies are never compared.
2. Routing: two sets that reach the similarity share one of the first
   ``n - ceil(t n) + 1`` hashes of any fixed global order.  The order puts hashes that
   many texts share last, so shared passages seldom route.  A route that many classes
   take is dealt into chunks by fingerprint, each with the route's pivots: its classes
   that share the most routes.
3. Inside a block a signature tree is built: nodes hold OR- and AND-combined bitmaps and
   a size range.  A dual traversal drops node pairs whose largest possible overlap is too
   small.  A first pass over bitmaps alone finds the classes that have a possible partner
   at all; only their sets are shipped, and what the tree leaves is compared exactly.
4. A class first meets others in its largest block only.  Routes that still hold several
   components follow, grouped by their main component: classes outside it meet all
   others of the group, chunk by chunk.  Links are reduced to components by star
   contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from routeloom.llm.common import begin, components, distribute, fresh, local_path, map_batches, task_cache
from routeloom.session import cut_lineage, ship_package

#: Hashes that come last in the order; any set gives the same result.
LAST_HASHES = 200_000
LOCALLY_COMMON = 2
BUFFER = 1 << 20
PIVOTS = 8
CHUNK = 256
LEAF = 4
MOST_BITS = 1 << 17
BLOOM_BITS = 1 << 23

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; fewer words than ``width`` count as one n-gram."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = w[:n].copy()
    for k in range(1, width):
        h = (h ^ (h >> np.uint64(29))) * _A + w[k : k + n] * _B
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(29)
    return np.unique(h)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of the set, as two signed halves."""
    d = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def signature(hashes: np.ndarray) -> bytes:
    """Bitmap of the set's hashes, one to two bits for each, bit ``hash mod size``."""
    size = signature_bits(len(hashes))
    marks = np.zeros(size, np.uint8)
    marks[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def signature_bits(n: int) -> int:
    return min(MOST_BITS, 1 << max(6, (n - 1).bit_length()))


def folded(bits: int, size: int, target: int) -> int:
    """The bitmap of the same set at a smaller size."""
    while size > target:
        size >>= 1
        bits = (bits & ((1 << size) - 1)) | bits >> size
    return bits


def route_length(n: int, num: int, den: int) -> int:
    """So many first hashes of a set of ``n`` meet those of every set that reaches the similarity."""
    return n - -(-num * n // den) + 1


def prefix(hashes: np.ndarray, last: np.ndarray, num: int, den: int) -> np.ndarray:
    """The hashes by which a set is routed."""
    size = route_length(len(hashes), num, den)
    if len(last):
        at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
        common = last[at] == hashes
        hashes = np.concatenate([hashes[~common], hashes[common]])
    return hashes[:size]


@task_cache(4)
def _last(name: str) -> np.ndarray:
    return np.fromfile(local_path(name), dtype=np.uint64)


class Node:
    __slots__ = ("low", "high", "bits", "either", "every", "children", "sets")

    def __init__(self, children: list, sets: list[int], low: int, high: int, bits: int, either: int, every: int):
        self.children, self.sets, self.low, self.high = children, sets, low, high
        self.bits, self.either, self.every = bits, either, every


class SignatureTree:
    """Classes of one block: ``sizes`` and bitmaps, and for ``links`` the sets themselves."""

    def __init__(
        self,
        sizes: list[int],
        signatures: list[bytes],
        num: int,
        den: int,
        sets: list[np.ndarray] | None = None,
        groups: list | None = None,
        sides: list[int] | None = None,
    ):
        self.sizes, self.sets, self.num, self.den, self.sides = sizes, sets, num, den, sides
        self.parent = list(range(len(sizes)))
        first: dict = {}
        for k, g in enumerate(groups or []):
            if g is not None:
                self.parent[k] = first.setdefault(g, k)
        # One tree for each bitmap size: folding long bitmaps to short ones would fill them.
        leaves: dict[int, list[Node]] = {}
        for k, s in enumerate(signatures):
            mark = int.from_bytes(s, "little")
            leaves.setdefault(8 * len(s), []).append(Node([], [k], sizes[k], sizes[k], 8 * len(s), mark, mark))
        self.roots = []
        for level in leaves.values():
            level.sort(key=lambda n: (n.either & 0xFFFF, n.low, n.sets[0]))
            while len(level) > 1:
                level = [self._join(level[k : k + LEAF]) for k in range(0, len(level), LEAF)]
            self.roots += level

    def _join(self, nodes: list[Node]) -> Node:
        if len(nodes) == 1:
            return nodes[0]
        either, every = 0, -1
        for n in nodes:
            either |= n.either
            every &= n.every
        return Node(nodes, [], min(n.low for n in nodes), max(n.high for n in nodes), nodes[0].bits, either, every)

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def possible(self, a: Node, b: Node) -> bool:
        """Whether some pair below the nodes may overlap enough.

        A bit that all sets of one node have and none of the other has stands for at least
        one hash outside the intersection.
        """
        if a.high * self.den < self.num * b.low or b.high * self.den < self.num * a.low:
            return False
        bits = min(a.bits, b.bits)
        a_either, a_every = folded(a.either, a.bits, bits), folded(a.every, a.bits, bits)
        b_either, b_every = folded(b.either, b.bits, bits), folded(b.every, b.bits, bits)
        most = min(a.high - (a_every & ~b_either).bit_count(), b.high - (b_every & ~a_either).bit_count())
        return (self.num + self.den) * most >= self.num * (a.low + b.low)

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Dual traversal: pairs of classes whose bitmaps and sizes leave the similarity possible."""
        todo = [(a, b) for k, a in enumerate(self.roots) for b in self.roots[k:]]
        while todo:
            a, b = todo.pop()
            if a is b:
                below = a.children
                todo += [(below[i], below[j]) for i in range(len(below)) for j in range(i, len(below))]
            elif not self.possible(a, b):
                continue
            elif not a.children and not b.children:
                yield a.sets[0], b.sets[0]
            elif not b.children or (a.children and a.high - a.low >= b.high - b.low):
                todo += [(c, b) for c in a.children]
            else:
                todo += [(a, c) for c in b.children]

    def partnered(self) -> list[int]:
        """Classes that may be linked to a class of the block outside their known group (of the other side, if sides are given)."""
        found: set[int] = set()
        for x, y in self.pairs():
            if self.parent[x] != self.parent[y] and not (self.sides and self.sides[x] == self.sides[y]):
                found.update((x, y))
        return sorted(found)

    def links(self) -> Iterator[tuple[int, int]]:
        """A spanning set of the pairs that reach the similarity; known groups are linked already."""
        for x, y in self.pairs():
            p, q = self.find(x), self.find(y)
            if p != q and self.linked(self.sets[x], self.sets[y]):
                self.parent[q] = p
                yield x, y

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[at] == small).sum())
        return self.den * both >= self.num * (len(x) + len(y) - both)


def _by_block(rows: DataFrame, solve, schema: str) -> DataFrame:
    """``solve(members) -> rows`` for each block of ``rows`` (block first); a block is bounded by its chunks."""
    ship_package(rows.sparkSession)
    made = T.StructType.fromDDL(schema)
    out_schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in made])

    def run(batches):
        begin(__name__)
        key, members, out = None, [], []

        def full():
            columns = list(zip(*out)) or [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for block, *row in zip(*[c.to_pylist() for c in part.columns]):
                    if block != key:
                        out += solve(members) if len(members) > 1 else []
                        key, members = block, []
                    members.append(row)
                if len(out) > 10_000:
                    yield full()
                    out.clear()
        out += solve(members) if len(members) > 1 else []
        yield full()

    return rows.repartition("block").sortWithinPartitions(*rows.columns[:2]).mapInArrow(run, made)


def _links(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links ``a, b`` found in each block of (block, cls, packed, comp)."""

    def solve(members: list[list]) -> list[tuple[int, int]]:
        sets = [shingles(unpack(m[1]), width) for m in members]
        tree = SignatureTree([len(h) for h in sets], [signature(h) for h in sets], num, den, sets, [m[2] for m in members])
        return [(members[x][0], members[y][0]) for x, y in tree.links()]

    return _by_block(rows.select("block", "cls", "packed", "comp"), solve, "a long, b long")


def _partnered(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``block, cls`` of (block, cls, n, sig, comp, side) rows that may be linked to another component in their block."""

    def solve(members: list[list]) -> list[tuple[int, int]]:
        sizes, signs, groups, sides = ([m[k] for m in members] for k in (2, 3, 4, 5))
        tree = SignatureTree(sizes, signs, num, den, groups=groups, sides=sides if any(sides) else None)
        return [(members[k][1], members[k][0]) for k in tree.partnered()]

    sent = rows.select("block", "cls", F.col("block").alias("again"), "n", "sig", "comp", "side")
    return _by_block(sent, solve, "block long, cls long")


def pack(text: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text.encode())


def unpack(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode()


def _bloom(ids: DataFrame) -> bytes:
    """A bitmap of the ids' hashes, of BLOOM_BITS whatever their number.

    It only spares texts the way to the exact join on (class, key); full, it spares none.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS))
    words = (
        ids.select(bit.alias("bit"))
        .selectExpr("bit div 64 AS w", "shiftleft(1L, cast(bit % 64 AS int)) AS m")
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
        .collect()
    )
    out = np.zeros(-(-BLOOM_BITS // 64), "<i8")
    for r in words:
        out[r["w"]] = r["m"]
    return out.tobytes()


@task_cache(2)
def _marks(name: str) -> np.ndarray:
    return np.unpackbits(np.fromfile(local_path(name), np.uint8), bitorder="little")


def link_sets(df: DataFrame, width: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component``: sets whose Jaccard similarity is at least num/den are linked.

    ``component`` is the smallest key reachable.  A text without words is linked with
    nothing and is its own component; a null key's row has the component its text has, if
    any other row shares it.  Rows that repeat a key stay rows of their own.  An empty
    table gives no rows.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def first_pass(slices):
        early: list[np.ndarray] = []
        held = 0

        def common():
            """Hashes that more than one text of the buffer would be routed by, or nearly."""
            h, n = np.unique(np.concatenate(early), return_counts=True) if early else (np.zeros(0, np.uint64), np.zeros(0, int))
            h, n = h[n >= LOCALLY_COMMON], n[n >= LOCALLY_COMMON]
            none = [None] * len(h)
            return none, none, none, none, none, h.astype(np.int64).tolist(), n.tolist()

        for ids, texts in slices:
            sets = [shingles(t, width) for t in texts]
            fps = [fingerprint(h) if len(h) else (None, None) for h in sets]
            none = [None] * len(ids)
            signs = [signature(h) if len(h) else None for h in sets]
            yield ids, list(map(len, sets)), [f for f, _ in fps], [g for _, g in fps], signs, none, none
            for h in {f: h for f, h in zip(fps, sets) if len(h)}.values():
                early.append(h[: 2 * route_length(len(h), num, den)])
                held += len(early[-1])
            if held > BUFFER:
                yield common()
                early.clear()
                held = 0
        yield common()

    id_type = docs.schema["id"].dataType.simpleString()
    seen = cut_lineage(map_batches(docs, first_pass, f"id {id_type}, n int, f long, g long, sig binary, hash long, times long"))
    # A class is known by the first half of its fingerprint, or by the second where that half is not its own.
    halves = seen.where("f is not null").groupBy("f").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y")
    moved = frozenset(r["f"] for r in halves.select("f").collect())
    cls = F.when(F.col("f").isin(*moved), F.col("g")).otherwise(F.col("f")) if moved else F.col("f")
    rows = seen.where("hash is null").select("id", "n", cls.alias("cls"), "sig")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"))

    # The bounded list of hashes that come last; it steers routing only.
    top = seen.where("hash is not null").groupBy("hash").agg(F.sum("times").alias("times")).where(F.col("times") > CHUNK // 8)
    top = top.orderBy(F.desc("times"), "hash").limit(LAST_HASHES).collect()
    last = distribute(spark, np.sort(np.array([r["hash"] for r in top], np.int64).astype(np.uint64)).tobytes(), "last.bin")

    def class_of(h: np.ndarray) -> int:
        f, g = fingerprint(h)
        return g if f in moved else f

    def route(slices):
        done: set = set()  # copies inside a task route once
        order = _last(last)
        for (texts,) in slices:
            hashes, who = [], []
            for t in texts:
                h = shingles(t, width)
                if not len(h) or (c := class_of(h)) in done:
                    continue
                if len(done) < 200_000:
                    done.add(c)
                p = prefix(h, order, num, den)
                hashes.append(p)
                who.append(np.full(len(p), c, np.int64))
            yield (np.concatenate(hashes).astype(np.int64), np.concatenate(who)) if hashes else ([], [])

    routes = cut_lineage(map_batches(docs.select("text"), route, "hash long, cls long"))
    shared = (
        routes.groupBy("hash")
        .agg(F.min("cls").alias("x"), F.max("cls").alias("y"), F.count(F.lit(1)).alias("n"))
        .where("x <> y")
        .select("hash", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    )
    met = cut_lineage(routes.join(shared, "hash").select("hash", "cls", "chunks", F.expr("pmod(xxhash64(cls), chunks)").alias("chunk")))
    split = cut_lineage(met.where("chunks > 1").distinct())
    # Pivots of a route in chunks: classes that share the most routes, so the least edited of many copies.
    shares = split.groupBy("cls").agg(F.count(F.lit(1)).alias("shares"))
    pivots = (
        split.join(shares, "cls")
        .groupBy("hash", (F.col("chunk") % PIVOTS).alias("part"))
        .agg(F.max(F.struct("shares", "cls")).alias("m"))
        .groupBy("hash")
        .agg(F.collect_set("m.cls").alias("pivots"))
    )
    # Blocks with the same members are one; a chunk's size is bounded.
    lists = (
        met.groupBy("hash", "chunk")
        .agg(F.collect_set("cls").alias("own"))
        .join(pivots, "hash", "left")
        .select(F.array_sort(F.array_union("own", F.coalesce("pivots", F.array().cast("array<long>")))).alias("members"), "pivots")
        .where(F.size("members") > 1)
        .select(F.xxhash64("members").alias("block"), F.hash("members").alias("check"), F.size("members").alias("m"), "members", "pivots")
        .dropDuplicates(["block", "check", "m"])
    )
    exploded = lists.select("block", "pivots", F.explode("members").alias("cls"))
    listed = cut_lineage(exploded.select("block", "cls", F.coalesce(F.array_contains("pivots", F.col("cls")), F.lit(False)).alias("pivot")))

    none = F.lit(None).cast("long")

    # Classes whose bitmap meets no possible partner in any block are done; those of a
    # route in chunks go on, as chunks meet each other only later.
    split = cut_lineage(met.where("chunks > 1").distinct())
    # Keys are compared inside a struct, as a class of rows without a key has a null for its least one.
    least = classes.select("cls", F.struct(F.col("least").alias("id")).alias("who"))
    bitmaps = rows.where("cls is not null").withColumn("who", F.struct("id")).join(least, ["cls", "who"], "left_semi").dropDuplicates(["cls"])
    met_by = listed.select("block", "cls").join(bitmaps, "cls")
    alive = _partnered(met_by.withColumns({"comp": none, "side": F.lit(0)}), num, den).select("cls").union(split.select("cls"))
    alive = cut_lineage(alive.distinct())
    member = listed.join(alive, "cls")
    sized = member.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = cut_lineage(member.join(sized, "block"))

    marks = distribute(spark, _bloom(alive.join(classes, "cls").select(F.col("least").alias("id"))), "alive.bin")

    def texts_of(slices):
        bits = _marks(marks)
        for ids, texts, at in slices:
            kept = [(i, h, t) for i, t, k in zip(ids, texts, at) if bits[k] and len(h := shingles(t, width))]
            yield [i for i, _, _ in kept], [class_of(h) for _, h, _ in kept], [pack(t) for _, _, t in kept]

    # One text stands for its class, that of its least key: other rows that pass the bitmap and
    # rows that repeat the key go before a block sees them.  Packed texts take less than half
    # of what their hashes would.
    hashed = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS)))
    passed = map_batches(hashed, texts_of, f"id {id_type}, cls long, packed binary").select("cls", F.struct("id").alias("who"), "packed")
    one_each = passed.dropDuplicates(["cls", "who"]).join(alive.join(least, "cls"), ["cls", "who"], "left_semi")
    texts = cut_lineage(one_each.select("cls", "packed"))

    best = member.groupBy("cls").agg(F.max(F.struct("size", "block")).alias("m")).select("cls", F.col("m.block").alias("block"))
    central = member.where("pivot").select("block", "cls").join(best.select("block").distinct(), "block")
    chosen = best.unionByName(central).distinct().join(texts, "cls").select("block", "cls", "packed", none.alias("comp"))
    links = cut_lineage(_links(chosen, width, num, den))

    nodes = alive.select(F.col("cls").alias("id"))
    group = lambda found: cut_lineage(components(nodes, found).select(F.col("id").alias("cls"), F.col("component").alias("comp")))
    so_far = group(links)
    # Second round: routes that still hold several components.  Those with the same main
    # component have much the same classes and form one group, in which each class outside
    # that component meets all.  Groups are dealt into chunks; bitmaps go first here too.
    marked = met.select("hash", "cls").join(so_far, "cls")
    counts = marked.groupBy("hash", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = (
        counts.groupBy("hash")
        .agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("kinds"))
        .where("kinds > 1")
        .select("hash", "main")
    )
    placed = cut_lineage(marked.join(main, "hash").select("main", "cls", "comp").distinct())
    sizes = placed.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = placed.join(sizes, "main").withColumn("chunk", F.expr("pmod(xxhash64(cls), chunks)"))
    outside = dealt.where("comp <> main")
    probes = outside.select("main", F.col("chunk").alias("probe")).distinct()
    left = outside.withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)"))).select(
        F.xxhash64("main", "other", "chunk").alias("block"), "cls", "comp", F.lit(1).alias("side")
    )
    right = dealt.join(probes, "main").select(F.xxhash64("main", "chunk", "probe").alias("block"), "cls", "comp", F.lit(2).alias("side"))
    open_ = cut_lineage(_partnered(left.union(right).join(bitmaps, "cls"), num, den).distinct())
    rest = open_.join(so_far, "cls").join(texts, "cls").select("block", "cls", "packed", "comp")
    links = cut_lineage(links.union(_links(rest, width, num, den)))
    so_far = group(links)

    joined = classes.join(so_far, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    roots = joined.groupBy("comp").agg(F.min("least").alias("component"))
    named = joined.join(roots, "comp").select("cls", "component")
    return rows.join(named, "cls", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component")
    )


def drop_near_copies(df: DataFrame, width: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of near copies: that of the smallest key.

    Where a key is null or given more than once, rows are told apart by key and text: a null
    key comes first, of rows that share key and text one stays, and rows of one key with
    different texts are different documents.  Texts without words are nobody's copy and all
    stay.  Empty tables stay empty; columns are those of ``df``.
    """
    unclear = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(f"`{key}`").isNull())
    if unclear.isEmpty():
        found = link_sets(df, width, num, den, key, text)
        gone = found.where(F.col("component") < F.col(key)).select(key)
        return df.join(gone, key, "left_anti").select(df.columns)
    who = fresh("who")
    told = df.withColumn(who, F.struct(F.col(f"`{key}`").alias("key"), F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(0)).alias("text")))
    found = link_sets(told, width, num, den, who, text)
    gone = found.where(F.col("component") < F.col(who)).select(who).distinct()
    twice = found.where("n_shingles > 0").groupBy(who).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(who)
    left = told.join(gone, who, "left_anti")
    single = left.join(twice, who, "left_anti").unionByName(left.join(twice, who, "left_semi").dropDuplicates([who]))
    return single.select(df.columns)
