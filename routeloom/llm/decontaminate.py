"""Benchmark decontamination by Wu-Manber search over words.

Every run of ``WINDOW`` words of a benchmark item is a pattern.  A search machine
holds, for patterns of one length, the shift of each two-word block: how far the
search may move when that block ends at the current word.  Only a block that ends
a pattern has shift zero; then its bucket's patterns are compared word for word.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession, functions as F

from routeloom.llm.common import append, distribute, fresh, local_path, task_cache

WINDOW = 10
SHARD_BYTES = 32 << 20

# Word letters are 0-9, a-z and every byte above 127; A-Z becomes a-z first.
_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in bytes(range(256)).lower())


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


class Machine:
    """Patterns of one length: block shifts, and buckets by last block."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.buckets: dict = {}

    def _key(self, pattern: list[bytes], end: int):
        return (pattern[end - 1], pattern[end]) if self.block == 2 else pattern[end]

    def add(self, pattern: tuple, item) -> None:
        for end in range(self.block - 1, self.length):
            key = self._key(pattern, end)
            move = self.length - 1 - end
            self.shift[key] = min(move, self.shift.get(key, move))
        self.buckets.setdefault(self._key(pattern, self.length - 1), {}).setdefault(pattern, set()).add(item)

    def search(self, doc: list[bytes]):
        """(first word, items) of every place where a pattern stands."""
        at, n, m = self.length - 1, len(doc), self.length
        free, shift = m - self.block + 1, self.shift.get
        while at < n:
            key = (doc[at - 1], doc[at]) if self.block == 2 else doc[at]
            move = shift(key, free)
            if move:
                at += move
                continue
            items = self.buckets[key].get(tuple(doc[at - m + 1 : at + 1]))
            if items:
                yield at - m + 1, items
            at += 1


def build_machines(items: list[tuple], window: int = WINDOW) -> list[Machine]:
    by_length: dict[int, Machine] = {}
    for item, text in items:
        found = words(text)
        m = min(window, len(found))
        for k in range(len(found) - m + 1 if m else 0):
            by_length.setdefault(m, Machine(m)).add(tuple(found[k : k + m]), item)
    return [by_length[m] for m in sorted(by_length)]


@task_cache(2)
def machines(name: str) -> list[Machine]:
    with open(local_path(name), "rb") as f:
        return build_machines(pickle.load(f))


def union(spans: list) -> list[list[int]]:
    merged: list[list[int]] = []
    for start, end in sorted(map(list, spans)):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    return merged


def scan(found: list[bytes], search: list[Machine]) -> tuple[list[list[int]], set]:
    """Hit word intervals [first, end) in order, merged, and the items that occur."""
    spans, items = [], set()
    for machine in search:
        for start, which in machine.search(found):
            spans.append((start, start + machine.length))
            items |= which
    return union(spans), items - {None}


def shards(spark: SparkSession, benchmark: DataFrame, item: str, text: str, limit: int) -> list[str]:
    """The benchmark as files of at most ``limit`` bytes of text each (more only for one larger item).

    Items stream through the driver one shard at a time, so neither it nor a task
    ever holds more than a shard.
    """
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t"))
    rows = rows.where("t is not null and t <> ''")
    names, part, held = [], [], 0
    for row in rows.toLocalIterator():
        size = 4 * len(row["t"])
        if part and held + size > limit:
            names.append(distribute(spark, pickle.dumps(part), "benchmark.pkl"))
            part, held = [], 0
        part.append((row["i"], row["t"]))
        held += size
    return names + ([distribute(spark, pickle.dumps(part), "benchmark.pkl")] if part else [])


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``df`` with ``n_words``, ``hits`` (word intervals), ``items`` (sorted strings) and ``n_hit``.

    A benchmark larger than ``shard_bytes`` is searched shard by shard, each pass
    adding to the intervals and items of the one before.  Null texts have no words;
    a benchmark row with a null item hits words but is no item; items without words match
    nothing; repeated rows stay.
    """
    hits, found_items = fresh("hits"), fresh("items")
    out = df
    names = shards(df.sparkSession, benchmark, item, item_text, shard_bytes)
    for k, name in enumerate(names):
        last, first = k == len(names) - 1, k == 0

        def run(texts, old_hits=None, old_items=None, name=name, first=first):
            search = machines(name)
            spans, items, counts, hit = [], [], [], []
            for j, t in enumerate(texts):
                doc = words(t)
                a, b = scan(doc, search)
                if not first:
                    a = union([*a, *old_hits[j]])
                    b = b | set(old_items[j])
                spans.append(a)
                items.append(sorted(b))
                counts.append(len(doc))
                hit.append(sum(y - x for x, y in a))
            return counts, spans, items, hit

        names_out = ("hits", "items") if last else (hits, found_items)
        inputs = [text] if first else [text, hits, found_items]
        out = append(
            out, inputs, run, f"n_words long, {names_out[0]} array<array<int>>, {names_out[1]} array<string>, n_hit long"
        )
    if not names:

        def count(texts):
            return [len(words(t)) for t in texts], [[]] * len(texts), [[]] * len(texts), [0] * len(texts)

        out = append(out, [text], count, "n_words long, hits array<array<int>>, items array<string>, n_hit long")
    return out.drop(hits, found_items)
