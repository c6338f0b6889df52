"""Phrase collocations from weighted acyclic automata of n-gram counts.

A task counts the n-grams of its texts in a bounded buffer.  Each time the buffer is full its
n-grams are sorted, cut by prefix range (an interval of the first word's hash, dealt out by the
second), and every piece is compiled into a count transducer: an acyclic automaton over (language, word,
word, ...) whose equal states are registered once.  An arc's weight is the number of n-grams
before it, so the weights along a path sum to the n-gram's rank, which addresses its count.

The transducers of a range, from all tasks, are united: their n-grams are enumerated in step
and equal ones summed.  N-grams below the smallest count are left out of the united transducer,
as neither a candidate nor a part of one can be rarer.  For the same reason pairs are only
counted where both words are frequent, and triples where both pairs are: a bitmap of fixed
largest size tells tasks so beforehand; its false positives cost time, never results.

Parts of candidates are looked up by composing the requests with the transducer of the part's
range.  Ranges that many candidates ask for are copied, and requests dealt among the copies.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from routeloom.llm.common import begin, distribute, local_path, map_batches, task_cache
from routeloom.session import cut_lineage, ship_package

#: Distinct n-grams and words that a task holds before it writes a shard.
SHARD_GRAMS = 1_000_000
SHARD_WORDS = 1 << 19
#: Words counted at once; a shard never numbers more than SHARD_WORDS + STEP_WORDS of them.
STEP_WORDS = 1 << 20
WORD_BITS = 21
#: Bytes of text tokenised at once, and text bytes for each prefix range.
TEXT_BYTES = 4 << 20
RANGE_BYTES = 32 << 20
MAX_BITS = 1 << 27
#: Requests that one copy of a range answers.
COPY_REQUESTS = 200_000

BREAK = b"\xff"  # no UTF-8 text holds this byte
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0xFF if c in _SEPARATORS else 0x20 if c == 9 else c for c in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts, with a break marker between pieces and between texts."""
    joined = BREAK.join(texts).lower().translate(_TABLE)  # bytes.lower: A-Z only
    return joined.replace(BREAK, b" \xff ").split()


def word_hash(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * _MIX[0] + (second ^ _MIX[1]) * _MIX[2]
    return x ^ (x >> np.uint64(29))


def range_of(hashes: list[np.ndarray], ranges: int) -> np.ndarray:
    """Number of an n-gram's prefix range, given its words' hashes.

    The range is an interval of the first word's hash.  Longer n-grams have fewer, wider
    intervals, each dealt out by the second word, so that no first word fills a range.
    """
    shift = np.uint64(32)
    deal = math.isqrt(ranges) if len(hashes) > 1 else 1
    at = (hashes[0] >> shift) * np.uint64(ranges // deal) >> shift
    if deal > 1:
        at = at * np.uint64(deal) + (hashes[1] >> shift) % np.uint64(deal)
    return at.astype(np.int64)


def prefix_hash(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of an n-gram's first two words, given its words' hashes."""
    return hashes[0] if len(hashes) == 1 else pair_hash(hashes[0], hashes[1])


class Transducer:
    """Sorted n-grams over byte labels with their counts, as a minimal acyclic automaton."""

    def __init__(self, labels: list[bytes], width: np.ndarray, label: np.ndarray, target: np.ndarray, levels: np.ndarray, counts: np.ndarray):
        """``width`` is the number of arcs of each state, ``levels`` the number of states per depth, from the end on."""
        self.labels, self.width, self.label, self.target, self.levels, self.counts = labels, width, label, target, levels, counts
        self.first = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        self.depth = len(levels)

    def before(self) -> np.ndarray:
        """Weight of each arc: the n-grams before it."""
        below, out = np.ones(1, np.int64), []
        ends = 1 + np.cumsum(self.levels)
        for s, e in zip((ends - self.levels).tolist(), ends.tolist()):
            reach = below[self.target[self.first[s] : self.first[e]]]
            starts = self.first[s:e] - self.first[s]
            earlier = np.cumsum(reach) - reach
            out.append(earlier - np.repeat(earlier[starts], self.width[s:e]))
            below = np.concatenate([below, np.add.reduceat(reach, starts)])
        return np.concatenate(out)

    @classmethod
    def build(cls, labels: list[bytes], grams: np.ndarray, counts: np.ndarray) -> Transducer:
        """From sorted distinct rows of label numbers; states are made from the ends backwards."""
        n, depth = grams.shape
        register: dict = {}  # states of one depth; those of others hold words of other lengths
        sizes, label, target, levels = [np.zeros(1, np.int64)], [], [], []  # state 0 accepts
        made = 1
        ends = np.arange(n)  # first row of each prefix of the length at hand
        states = np.zeros(n, np.int64)
        for d in range(depth - 1, -1, -1):
            new = np.arange(len(ends)) == 0
            if d:
                rows = grams[ends, :d]
                new[1:] |= (rows[1:] != rows[:-1]).any(1)
            starts = np.flatnonzero(new)
            arcs, goals = grams[ends, d].astype(np.int64), states
            width = np.diff(np.append(starts, len(ends)))
            mine = np.empty(len(starts), np.int64)
            begun = made
            # states with one arc are told apart all at once
            one = width == 1
            keys, which = np.unique(arcs[starts[one]] << 32 | goals[starts[one]], return_inverse=True)
            mine[one] = made + which
            sizes.append(np.ones(len(keys), np.int64))
            label.append(keys >> 32)
            target.append(keys & 0xFFFFFFFF)
            made += len(keys)
            many = np.flatnonzero(~one)
            found: list[int] = []
            for g, s, e in zip(many.tolist(), starts[many].tolist(), (starts + width)[many].tolist()):
                key = arcs[s:e].tobytes() if d == depth - 1 else (arcs[s:e].tobytes(), goals[s:e].tobytes())
                state = register.get(key)
                if state is None:
                    state = register[key] = made
                    made += 1
                    found.append(g)
                    label.append(arcs[s:e])
                    target.append(goals[s:e])
                mine[g] = state
            sizes.append(width[found])
            register.clear()
            levels.append(made - begun)
            ends, states = ends[starts], mine
        join = lambda parts: np.concatenate(parts).astype(np.int32)
        return cls(labels, join(sizes), join(label), join(target), np.array(levels), np.asarray(counts, np.int64))

    def grams(self) -> np.ndarray:
        """All n-grams in order, as rows of label numbers."""
        state = np.array([len(self.first) - 2])
        columns: list[np.ndarray] = []
        for _ in range(self.depth):
            count = self.first[state + 1] - self.first[state]
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            arc = np.repeat(self.first[state], count) + offset
            columns = [np.repeat(c, count) for c in columns] + [self.label[arc]]
            state = self.target[arc]
        return np.stack(columns, 1)

    def find(self, columns: list[list[bytes]]) -> np.ndarray:
        """Rank of each n-gram, given position by position; -1 where there is none."""
        number = {w: k for k, w in enumerate(self.labels)}
        n = len(columns[0])
        state, rank = np.full(n, len(self.first) - 2), np.zeros(n, np.int64)
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        keys = owner.astype(np.int64) << 32 | self.label
        alive, before = np.ones(n, bool), self.before()
        for words in columns:
            code = np.fromiter((number.get(w, -1) for w in words), np.int64, n)
            key = state.astype(np.int64) << 32 | np.maximum(code, 0)
            arc = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            alive &= (code >= 0) & (keys[arc] == key)
            state = np.where(alive, self.target[arc], 0)
            rank += np.where(alive, before[arc], 0)
        return np.where(alive, rank, -1)

    def dump(self) -> bytes:
        """The automaton as bytes; weights follow from its shape and are not stored."""
        text = b"".join(self.labels)
        lengths = np.fromiter(map(len, self.labels), np.int64, len(self.labels))
        parts = [x.astype(_small(x)) for x in (lengths, self.width, self.label, self.target, self.levels, self.counts)]
        head = np.array([len(text), *[x for p in parts for x in (len(p), p.itemsize)]], "<i8")
        return zstandard.ZstdCompressor(3).compress(head.tobytes() + b"".join(p.tobytes() for p in parts) + text)

    @classmethod
    def load(cls, blob: bytes) -> Transducer:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        _, *shape = np.frombuffer(raw, "<i8", 13).tolist()
        at, parts = 104, []
        for size, width in zip(shape[::2], shape[1::2]):
            parts.append(np.frombuffer(raw, f"<u{width}", size, at))
            at += size * width
        lengths, width, label, target, levels, counts = parts
        ends = np.cumsum(lengths, dtype=np.int64).tolist()
        labels = [raw[at + s : at + e] for s, e in zip([0, *ends], ends)]
        return cls(labels, width.astype(np.int64), label.astype(np.int32), target.astype(np.int32), levels.astype(np.int64), counts.astype(np.int64))


def _small(values: np.ndarray) -> str:
    """The narrowest unsigned type that holds all values."""
    most = int(values.max()) if len(values) else 0
    return next(k for k in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(k).max)


def sum_equal(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of their counts."""
    if not len(grams):
        return grams, counts
    order = np.lexsort(grams.T[::-1])
    grams, counts = grams[order], counts[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]).any(1)
    starts = np.flatnonzero(new)
    return grams[starts], np.add.reduceat(counts, starts)


def byte_order(words: list[bytes]) -> np.ndarray:
    """Place of each word in byte order."""
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return place


def compiled(words: list[bytes], place: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Transducer:
    """A transducer of distinct n-grams over ``words`` (places by ``byte_order``); its labels are the words in use."""
    used = np.unique(grams)
    used = used[np.argsort(place[used])]
    number = np.zeros(len(words), np.int64)
    number[used] = np.arange(len(used))
    rows = number[grams]
    order = np.lexsort(rows.T[::-1])
    return Transducer.build([words[k] for k in used.tolist()], rows[order], counts[order])


class Shard:
    """Counts of the n-grams of one language in one task's buffer."""

    def __init__(self, lang: str, width: int, known: np.ndarray | None):
        self.lang, self.width, self.known = lang, width, known
        self.words: defaultdict = defaultdict()
        self.words.default_factory = self.words.__len__
        self.words[BREAK]  # number 0
        self.hashes = np.zeros(1, np.uint64)
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def _bit(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(len(self.known) * 8 - 1)
        return (self.known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def add(self, found: list[bytes]) -> None:
        if not found:
            return
        coded = pa.array(found, pa.binary()).dictionary_encode()
        known = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.words.__getitem__, known), np.int64, len(known))
        codes = number[coded.indices.to_numpy()]
        if len(self.words) > len(self.hashes):
            new = list(itertools.islice(self.words, len(self.hashes), None))
            self.hashes = np.concatenate([self.hashes, word_hash(self.lang, new)])
        span = len(codes) - self.width + 1
        if span <= 0:
            return
        columns = [codes[k : k + span] for k in range(self.width)]
        ok = np.ones(span, bool)
        for c in columns:
            ok &= c > 0
        if self.width == 2:
            frequent = self._bit(self.hashes)
            ok &= frequent[columns[0]] & frequent[columns[1]]
        elif self.width == 3:
            at = np.flatnonzero(ok)
            h = [self.hashes[c[at]] for c in columns]
            ok[at] = self._bit(pair_hash(h[0], h[1])) & self._bit(pair_hash(h[1], h[2]))
        key = np.zeros(int(ok.sum()), np.int64)
        for c in columns:
            key = key << WORD_BITS | c[ok]
        keys, counts = np.unique(key, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * SHARD_GRAMS:
            self.settle()

    def settle(self) -> None:
        if len(self.keys) > 1:
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.counts = [keys[starts]], [np.add.reduceat(counts, starts)]
        self.held = sum(map(len, self.keys))

    def pages(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        """``(range, transducer)`` of everything held."""
        self.settle()
        if not self.held:
            return
        keys, counts = self.keys[0], self.counts[0]
        mask = (1 << WORD_BITS) - 1
        grams = np.stack([keys >> WORD_BITS * (self.width - 1 - k) & mask for k in range(self.width)], 1)
        at = range_of([self.hashes[grams[:, k]] for k in range(self.width)], ranges)
        order = np.argsort(at, kind="stable")
        grams, counts, at = grams[order], counts[order], at[order]
        words = [*self.words, self.lang.encode()]
        place = byte_order(words)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        for s, e in zip(starts.tolist(), starts[1:].tolist() + [len(at)]):
            rows = np.concatenate([np.full((e - s, 1), len(words) - 1), grams[s:e]], 1)
            yield int(at[s]), compiled(words, place, rows, counts[s:e]).dump()


@task_cache(1)
def _bitmap(name: str) -> np.ndarray:
    return np.memmap(local_path(name), dtype="u1", mode="r")


def count_pages(docs: DataFrame, width: int, ranges: int, known: str | None) -> DataFrame:
    """``range, page``: transducers of each task's n-gram counts; ``docs`` is (lang, text)."""

    def run(slices):
        shards: dict[str, Shard] = {}
        bits = _bitmap(known) if known else None

        def flush():
            rows = [page for shard in shards.values() for page in shard.pages(ranges)]
            shards.clear()
            for k in range(0, len(rows), 64):
                yield [r for r, _ in rows[k : k + 64]], [p for _, p in rows[k : k + 64]]

        for langs, texts in slices:
            waiting: dict[str, list[bytes]] = defaultdict(list)
            sizes: dict[str, int] = defaultdict(int)

            def take(lang):
                sizes.pop(lang)
                found = tokens(waiting.pop(lang))
                for at in range(0, len(found), STEP_WORDS):
                    if lang not in shards:
                        shards[lang] = Shard(lang, width, bits)
                    # n-grams that start in this step
                    shards[lang].add(found[at : at + STEP_WORDS + width - 1])
                    if _full(shards):
                        yield from flush()

            for lang, text in zip(langs, texts):
                if text:
                    raw = text.encode()
                    waiting[lang].append(raw)
                    sizes[lang] += len(raw)
                    if sizes[lang] > TEXT_BYTES:
                        yield from take(lang)
            for lang in list(waiting):
                yield from take(lang)
        yield from flush()

    return map_batches(docs.select("lang", "text"), run, "range long, page binary")


def _full(shards: dict[str, Shard]) -> bool:
    if sum(len(s.words) for s in shards.values()) > SHARD_WORDS:
        return True
    if sum(s.held for s in shards.values()) > SHARD_GRAMS:
        for s in shards.values():
            s.settle()
    return sum(s.held for s in shards.values()) > SHARD_GRAMS


def _by_range(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Sorted batches cut where the first ``keys`` columns change."""
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield tuple(int(c[s]) for c in columns), batch.slice(s, e - s)


def unite(pages: DataFrame, ranges: int, least: int) -> DataFrame:
    """``range, n_grams, page, langs, totals``: per range one transducer of the n-grams with ``least`` or more.

    ``langs`` and ``totals`` are the occurrences of all n-grams of the range, rare ones too.
    """
    ship_package(pages.sparkSession)
    schema = pa.schema(
        [("range", pa.int64()), ("n_grams", pa.int64()), ("page", pa.binary()), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))]
    )

    def run(batches):
        begin(__name__)
        for (which,), parts in itertools.groupby(_by_range(batches, 1), key=lambda x: x[0]):
            words: defaultdict = defaultdict()
            words.default_factory = words.__len__
            held: list[tuple] = []
            count = 0
            for _, part in parts:
                for page in part.column(1):
                    t = Transducer.load(page.as_py())
                    code = np.fromiter(map(words.__getitem__, t.labels), np.int32, len(t.labels))
                    held.append((code[t.grams()], t.counts))
                    count += len(t.counts)
                    if count > 2 * SHARD_GRAMS:
                        held = [sum_equal(*map(np.concatenate, zip(*held)))]
                        count = len(held[0][0]) // 2
            grams, counts = sum_equal(*map(np.concatenate, zip(*held)))
            names = list(words)
            starts = np.flatnonzero(np.concatenate([[True], grams[1:, 0] != grams[:-1, 0]]))
            totals = np.add.reduceat(counts, starts)
            langs = [names[k].decode() for k in grams[starts, 0].tolist()]
            keep = counts >= least
            page = compiled(names, byte_order(names), grams[keep], counts[keep]).dump() if keep.any() else None
            columns = [[which], [int(keep.sum())], [page], [langs], [totals.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    dealt = pages.repartition(ranges, "range").sortWithinPartitions("range")
    return cut_lineage(dealt.mapInArrow(run, "range long, n_grams long, page binary, langs array<string>, totals array<bigint>"))


def _split(t: Transducer) -> tuple[list[str], list[list[bytes]]]:
    """Languages and word columns of all n-grams of a transducer."""
    grams = t.grams()
    return [t.labels[k].decode() for k in grams[:, 0].tolist()], [[t.labels[k] for k in grams[:, d].tolist()] for d in range(1, t.depth)]


def _hashes(langs: list[str], columns: list[list[bytes]]) -> list[np.ndarray]:
    seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in set(langs)}
    digest = xxhash.xxh64_intdigest
    return [np.fromiter((digest(w, seeds[lang]) for lang, w in zip(langs, words)), np.uint64, len(words)) for words in columns]


def bitmap_of(united: DataFrame) -> str:
    """Distributed bitmap of the hashes of all n-grams in ``united``, 16 bits each, at most ``MAX_BITS``."""
    total = united.agg(F.coalesce(F.sum("n_grams"), F.lit(0)).alias("n")).first()["n"]
    bits = min(MAX_BITS, 1 << max(16, math.ceil(math.log2(16 * total + 1))))

    def run(slices):
        for (pages,) in slices:
            for page in pages:
                if page:
                    langs, columns = _split(Transducer.load(page))
                    at = np.unique(prefix_hash(_hashes(langs, columns)) & np.uint64(bits - 1)).astype(np.int64)
                    word = at >> 5
                    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                    yield word[starts], np.bitwise_or.reduceat(np.int64(1) << (at & 31), starts)

    words = map_batches(united.select("page"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 32, "<u4")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return distribute(united.sparkSession, out.tobytes(), "frequent.bin")


def _number(width: int, which: np.ndarray | int, rank: np.ndarray) -> np.ndarray:
    """One number for an n-gram: its width, range and rank in the range."""
    return (np.int64(width) << 58) | (np.int64(1) * which << 32) | rank


def requests(united: dict[int, DataFrame], ranges: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Candidates (``cid, lang, phrase, a``) and what they ask for (``width, range, cid, cut, side, a, lang, part``).

    ``part`` is the part's words joined by spaces; a request goes to the part's range.
    """
    found, asked = [], []
    for width, pages in united.items():

        def candidates(slices, width=width):
            for numbers, blobs in slices:
                for which, blob in zip(numbers, blobs):
                    if blob:
                        t = Transducer.load(blob)
                        langs, columns = _split(t)
                        phrases = [b" ".join(x).decode() for x in zip(*columns)]
                        yield _number(width, which, np.arange(len(langs))), langs, phrases, t.counts

        def parts(slices, width=width):
            for numbers, blobs in slices:
                for which, blob in zip(numbers, blobs):
                    if not blob:
                        continue
                    t = Transducer.load(blob)
                    langs, columns = _split(t)
                    hashes = _hashes(langs, columns)
                    cid = _number(width, which, np.arange(len(langs)))
                    for cut in range(1, width):
                        for side, chosen in enumerate((slice(0, cut), slice(cut, width))):
                            size = len(columns[chosen])
                            at = range_of(hashes[chosen], ranges[size])
                            text = [b" ".join(x) for x in zip(*columns[chosen])]
                            fixed = [np.full(len(cid), x, np.int32) for x in (size, cut, side)]
                            yield fixed[0], at, cid, fixed[1], fixed[2], t.counts, langs, text

        chosen = pages.select("range", "page")
        found.append(map_batches(chosen, candidates, "cid long, lang string, phrase string, a long"))
        asked.append(map_batches(chosen, parts, "width int, range long, cid long, cut int, side int, a long, lang string, part binary"))
    every = lambda frames: frames[0].unionByName(frames[1]) if len(frames) > 1 else frames[0]
    return every(found), every(asked)


def answer(asked: DataFrame, united: dict[int, DataFrame]) -> DataFrame:
    """``cid, cut, side, a, n, part_cid``: each request with the count of its part."""
    ship_package(asked.sparkSession)
    load = asked.groupBy("width", "range").agg(F.ceil(F.count(F.lit(1)) / COPY_REQUESTS).cast("int").alias("copies"))
    asked = asked.join(load, ["width", "range"]).withColumn("copy", F.pmod(F.xxhash64("cid"), F.col("copies")).cast("int"))
    pages = None
    for width, frame in united.items():
        one = frame.where("page is not null").select(F.lit(width).alias("width"), "range", "page")
        pages = one if pages is None else pages.unionByName(one)
    pages = pages.join(load, ["width", "range"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    key = ["width", "range", "copy"]
    left = pages.select(*key, F.lit(0).alias("kind"), none("long").alias("cid"), none("int").alias("cut"), none("int").alias("side"), none("long").alias("a"), none("string").alias("lang"), F.col("page").alias("body"))
    right = asked.select(*key, F.lit(1).alias("kind"), "cid", "cut", "side", "a", "lang", F.col("part").alias("body"))
    dealt = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "kind")
    schema = pa.schema([("cid", pa.int64()), ("cut", pa.int32()), ("side", pa.int32()), ("a", pa.int64()), ("n", pa.int64()), ("part_cid", pa.int64())])

    def run(batches):
        begin(__name__)
        held, t = None, None
        for (width, which, _copy, kind), part in _by_range(batches, 4):
            if kind == 0:
                held, t = (width, which), Transducer.load(part.column(9)[0].as_py())
                continue
            assert held == (width, which), "a part has no transducer"
            words = [x.split(b" ") for x in part.column(9).to_pylist()]
            langs = [x.encode() for x in part.column(8).to_pylist()]
            rank = t.find([langs, *map(list, zip(*words))])
            if (rank < 0).any():
                raise ValueError("a part of a candidate is missing from its range")
            made = [*part.columns[4:8], pa.array(t.counts[rank]), pa.array(_number(width, which, rank))]
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    return dealt.mapInArrow(run, "cid long, cut int, side int, a long, n long, part_cid long")


def collocations(
    df: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    A-Z are lower-cased; texts are cut at ``.,;:!?`` and line breaks into pieces and those at
    blanks and tabs into words.  Candidates are phrases of 2 to ``longest`` (2 or 3) words with
    ``least`` occurrences ``a``.  Of all cuts into two parts with ``l`` and ``r`` occurrences the
    lowest floor(1000000 * a * a / (l * r)) counts, the first of equal ones.  A candidate goes if
    a longer one holds it and has ``inside`` percent of its occurrences.  Order: score, a
    (descending), phrase (byte order).  ``n`` is the number of words of the language.

    A null language is ``und``.  Null and empty texts hold no words; an empty table gives no
    rows.  Repeated rows count each time.  Other columns are not read.
    """
    if longest not in (2, 3):
        raise ValueError("phrases have 2 or 3 words")
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    united: dict[int, DataFrame] = {}
    known = None
    for width in range(1, longest + 1):
        united[width] = unite(count_pages(docs, width, n_ranges, known), n_ranges, least)
        if width < longest:
            known = bitmap_of(united[width])

    totals = united[1].select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
    found, asked = requests({w: united[w] for w in range(2, longest + 1)}, dict.fromkeys(range(1, longest + 1), n_ranges))
    answers = cut_lineage(answer(cut_lineage(asked), united))

    # a candidate that is a part of a longer one, with so many of its occurrences
    covered = answers.where((F.col("part_cid") >= F.lit(2).cast("long") * (1 << 58)) & (100 * F.col("a") >= inside * F.col("n"))).select(F.col("part_cid").alias("cid")).distinct()
    sides = answers.groupBy("cid", "cut").agg(
        F.max("a").alias("a"), F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r")
    )
    exact = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(13,0)) * cast(a as decimal(13,0)) div (cast(l as decimal(13,0)) * cast(r as decimal(13,0)))")
    lowest = sides.withColumn("score", exact).groupBy("cid").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    kept = found.join(covered, "cid", "left_anti").join(lowest, "cid")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
