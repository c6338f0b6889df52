"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words are compiled, with the ids they encode to, into an automaton whose
words share prefixes and suffixes.  Walking a word adds up arc weights to the
word's number, and the number addresses its ids.  The automaton is one file that
tasks memory-map, so the workers of a machine share its pages.  Words that it
does not hold are merged exactly by the vocabulary's merge ranks.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections import Counter
from itertools import repeat

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from routeloom.llm.common import append, distribute, local_path, map_batches, task_cache

# The split pattern of the byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LEXICON_WORDS = 60_000
COUNTERS = 1 << 17
MEMO = 250_000
LONG_WORD = 200
#: Longest word (bytes) that is merged together with others.
BATCHED_WORD = 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge ranks, byte ids and special tokens of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = [vocab[c] for c in letters]
        to_byte = {c: b for b, c in enumerate(letters)}
        self.bytes_of: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left], vocab[right]] = k
            self.made.append(vocab[left + right])
        self.first_ids, self.made_ids = np.array(self.byte_id, np.int64), np.array(self.made, np.int64)
        self.span = max(vocab.values()) + 1
        keys = np.array([a * self.span + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        self.words = regex.compile(WORDS)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged until none is left."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        none, get, made = len(self.made), self.rank.get, self.made
        while len(ids) > 1:
            ranks = list(map(get, zip(ids, ids[1:]), repeat(none)))
            best = min(ranks)
            if best == none:
                break
            out, k, last = [], 0, len(ids) - 1
            while k <= last:
                if k < last and ranks[k] == best:
                    out.append(made[best])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32 bit) of many words at once, equal to ``merge`` of each.

        Words of one length are the rows of a matrix.  In each round every row merges its
        leftmost pair of lowest rank and moves on to the next shorter length; a merged pair
        only takes part in pairs of higher rank, so one merge a round keeps the order.
        """
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if len(word) > BATCHED_WORD:
                out[k] = np.array(self.merge(word), "<u4").tobytes()
            elif word:
                by_length.setdefault(len(word), []).append(k)
        carried, owner = np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
        for length in range(max(by_length, default=0), 0, -1):
            if own := by_length.get(length):
                raw = np.frombuffer(b"".join([words[k] for k in own]), "u1").reshape(len(own), length)
                rows = self.first_ids[raw]
                carried = np.concatenate([carried, rows]) if len(carried) else rows
                owner = np.concatenate([owner, np.array(own)])
            if not len(carried):
                continue
            if length > 1:
                key = carried[:, :-1] * self.span + carried[:, 1:]
                place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[place] == key, self.pair_ranks[place], len(self.made))
                at = rank.argmin(1)
                best = rank[np.arange(len(rank)), at]
                done = best == len(self.made)
            else:
                done = np.ones(len(carried), bool)
            flat = carried[done].astype("<u4").tobytes()
            for n, k in enumerate(owner[done].tolist()):
                out[k] = flat[4 * length * n : 4 * length * (n + 1)]
            if length == 1 or done.all():
                carried, owner = np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
                continue
            rows, owner, at, best = carried[~done], owner[~done], at[~done], best[~done]
            line = np.arange(len(rows))
            rows[line, at] = self.made_ids[best]
            stay = np.ones(rows.shape, bool)
            stay[line, at + 1] = False
            carried = rows[stay].reshape(len(rows), length - 1)
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for a very long word, by a queue over a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, k) for k in range(n - 1) if (r := self.rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(queue)
        gone = bytearray(n)
        while queue:
            r, k = heapq.heappop(queue)
            j = after[k]
            if gone[k] or j >= n or self.rank.get((ids[k], ids[j])) != r:
                continue
            ids[k] = self.made[r]
            gone[j] = 1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (x := self.rank.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(queue, (x, a))
        return [t for k, t in enumerate(ids) if not gone[k]]


@task_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Words and their ids as one file: a minimal acyclic transducer and an id table.

    Words are added in byte order; once a branch cannot grow any more its states are
    replaced by equal registered ones.  An arc's weight is the number of words that
    sort before its branch, so weights along a path sum to the word's rank.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    open_path: list[list] = [[False, []]]  # [accepts, arcs (label, state)]

    def close(depth: int, labels: bytes) -> None:
        while len(open_path) > depth + 1:
            accepts, arcs = open_path.pop()
            key = (accepts, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            open_path[-1][1].append((labels[len(open_path) - 1], register[key]))

    last = b""
    for word in words:
        same = 0
        top = min(len(word), len(last))
        while same < top and word[same] == last[same]:
            same += 1
        close(same, last)
        open_path.extend([False, []] for _ in word[same:])
        open_path[-1][0] = True
        last = word
    close(0, last)
    states.append((open_path[0][0], tuple(open_path[0][1])))

    below: list[int] = []
    for accepts, arcs in states:  # a state's targets were registered before it
        below.append(accepts + sum(below[t] for _, t in arcs))
    keys, targets, weights = [], [], []
    for k, (accepts, arcs) in enumerate(states):
        before = int(accepts)
        for label, target in arcs:
            keys.append(k << 8 | label)
            targets.append(target)
            weights.append(before)
            before += below[target]
    ids = [entries[w] for w in words]
    parts = [
        np.array(keys, "<i8"),
        np.array(targets, "<i4"),
        np.array(weights, "<i4"),
        np.array([a for a, _ in states], "u1"),
        np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype="<i8")]).astype("<i4"),
        np.array([i for x in ids for i in x], "<u4"),
    ]
    head = struct.pack("<8q", len(states) - 1, max(map(len, words), default=0), *[len(p) for p in parts])
    out = bytearray(head)
    for p in parts:
        out += bytes(-len(out) % 8) + p.tobytes()
    return bytes(out)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype="u1", mode="r")
        self.root, self.longest, *sizes = struct.unpack("<8q", bytes(raw[:64]))
        at, parts = 64, []
        for size, kind in zip(sizes, ("<i8", "<i4", "<i4", "u1", "<i4", "<u4")):
            at += -at % 8
            end = at + size * np.dtype(kind).itemsize
            parts.append(raw[at:end].view(kind))
            at = end
        self.keys, self.targets, self.weights, self.accepts, self.starts, self.ids = parts

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Ids (little-endian 32 bit) of each word, None where the lexicon lacks it; all walk in step."""
        if not words or not len(self.keys):
            return [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), "u1")
        state = np.full(len(words), self.root, np.int64)
        number = np.zeros(len(words), np.int64)
        state[lengths > self.longest] = -1
        alive = np.flatnonzero(state >= 0)
        for depth in range(self.longest):
            alive = alive[lengths[alive] > depth]
            if not len(alive):
                break
            key = state[alive] << 8 | flat[starts[alive] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.targets[arc]
            number[alive] += self.weights[arc]
        found = (state >= 0) & (self.accepts[np.maximum(state, 0)] == 1)
        out: list[bytes | None] = [None] * len(words)
        begin, end = self.starts[number * found], self.starts[number * found + found]
        for k in np.flatnonzero(found).tolist():
            out[k] = self.ids[begin[k] : end[k]].tobytes()
        return out


class Encoder:
    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None):
        self.vocab, self.lexicon, self.memo = vocab, lexicon, {}

    def learn(self, words: set[str]) -> None:
        """Fill the memo for words it lacks: the lexicon first, exact merges for the rest."""
        if len(self.memo) + len(words) > MEMO:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        raw = [w.encode() for w in new]
        found = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(rest, self.vocab.merge_many([raw[k] for k in rest])):
            found[k] = ids
        self.memo.update(zip(new, found))

    def pieces(self, text: str) -> list:
        """The words of a text; special tokens come as their id's bytes."""
        v = self.vocab
        if v.split_special is None or not any(s in text for s in v.special):
            return v.words.findall(text)
        out: list = []
        for k, part in enumerate(v.split_special.split(text)):
            out += [struct.pack("<I", v.special[part])] if k % 2 else v.words.findall(part)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, in groups of texts that keep the memo bounded."""
        out: list[bytes] = []
        group: list[list] = []
        words: set = set()
        for text in texts:
            pieces = self.pieces(text or "")
            group.append(pieces)
            words.update(pieces)
            if len(words) > MEMO // 4:
                out += self._flush(group, words)
                group, words = [], set()
        return out + self._flush(group, words)

    def _flush(self, group: list[list], words: set) -> list[bytes]:
        special = {w for w in words if isinstance(w, bytes)}
        self.learn(words - special)
        if special:
            return [b"".join(w if isinstance(w, bytes) else self.memo[w] for w in pieces) for pieces in group]
        return [b"".join(map(self.memo.__getitem__, pieces)) for pieces in group]

    def decode(self, ids: bytes | None) -> str:
        known = self.vocab.bytes_of
        raw = b"".join(map(known.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
        return raw.decode("utf-8", "replace")


@task_cache(2)
def encoder(vocab_path: str, lexicon: str | None) -> Encoder:
    return Encoder(vocabulary(vocab_path), Lexicon(local_path(lexicon)) if lexicon else None)


def word_counts(df: DataFrame, text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``word, n``: space-separated words counted over all rows.

    A task keeps ``counters`` counters; when twice as many are in use the smallest
    share is taken off all of them (frequent-item summary), so a task's memory is
    bounded and every word above 1/counters of the task's words stays.
    """

    def count(slices):
        seen: Counter = Counter()
        for (texts,) in slices:
            for t in texts:
                if t:
                    seen.update(t.split(" "))
            if len(seen) > 2 * counters:
                floor = heapq.nlargest(counters + 1, seen.values())[-1]
                seen = Counter({w: n - floor for w, n in seen.items() if n > floor})
        top = heapq.nlargest(counters, seen.items(), key=lambda x: x[1])
        for at in range(0, len(top), 10_000):
            part = top[at : at + 10_000]
            yield [w for w, _ in part], [n for _, n in part]

    found = map_batches(df.select(F.col(f"`{text}`")), count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, vocab_path: str, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compile the ``size`` most frequent words of all rows; returns the distributed file's name.

    ``size`` bounds what reaches the driver.  Which words are in the lexicon decides
    speed only, never ids.
    """
    spark: SparkSession = df.sparkSession
    vocab = vocabulary(vocab_path)
    top = word_counts(df, text).orderBy(F.desc("n"), "word").limit(size).collect()
    entries: dict[bytes, list[int]] = {}
    for k, row in enumerate(top):
        for form in (" " + row["word"], row["word"])[: 1 + (k < size // 4)]:
            for word in vocab.words.findall(form):
                if len(word) <= 40:
                    entries.setdefault(word.encode(), [])
    for word in entries:
        entries[word] = vocab.merge(word)
    return distribute(spark, compile_lexicon(entries), "lexicon.bin")


def encode(df: DataFrame, vocab_path: str, text: str = "text", lexicon: str | None = None) -> DataFrame:
    """``df`` with ``ids`` (binary, unsigned 32 bit little-endian) and ``n_tokens``.

    A null or empty text gives no ids and 0.  Rows stay as they are, repeated ones too;
    columns called like the new ones are replaced.
    """
    lexicon = lexicon or build_lexicon(df, vocab_path, text)

    def run(texts):
        ids = encoder(vocab_path, lexicon).encode(texts)
        return ids, [len(b) // 4 for b in ids]

    return append(df, [text], run, "ids binary, n_tokens long")


def recode(df: DataFrame, vocab_path: str, text: str = "text", lexicon: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``ids``, ``n_tokens`` and ``decoded``, by one Python worker for each task."""
    lexicon = lexicon or build_lexicon(df, vocab_path, text)

    def run(texts):
        coder = encoder(vocab_path, lexicon)
        ids = coder.encode(texts)
        return ids, [len(b) // 4 for b in ids], [coder.decode(b) for b in ids]

    return append(df, [text], run, "ids binary, n_tokens long, decoded string")


def decode(df: DataFrame, vocab_path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the text of each row's ids; null ids give the empty text."""

    def run(values):
        return [[encoder(vocab_path, None).decode(v) for v in values]]

    return append(df, [ids], run, "decoded string")
