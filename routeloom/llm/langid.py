"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary that the learning rows hold; each
language has its own piece probabilities, learned by expectation maximisation.  A
word's probability is the sum over every way to cut it into pieces (forward
algorithm), pieces of any length and words of any length; all distinct words of a batch run
in step.  A text's score adds up its words' logarithms, so every character of every text
counts.
"""

from __future__ import annotations

import io
import re
from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from routeloom.llm.common import append, distribute, held_out, local_path, map_batches, task_cache
from routeloom.session import cut_lineage

#: Expected learning rows per language; a language with fewer gives all of them.
SAMPLE_PER_LANG = 5_000
ROUNDS = 2
LEARN_WORD = 40  # longer runs of letters are scored, but not learned from
LEARN_WORDS = 20_000  # words that a task learns from at once
RESCALE = 16  # steps between two rescalings of the forward sums
CELLS = 1 << 20  # places times words that run in step
UNKNOWN = 1e-5
SMOOTH = 0.05
MEMO = 200_000
UND = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"


def words(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


@task_cache(2)
def pieces_of(vocab_path: str) -> tuple[str, ...]:
    """Pieces of letters, with the word mark at most in front."""
    sp = sentencepiece.SentencePieceProcessor(model_file=vocab_path)
    found = {sp.id_to_piece(k).lower() for k in range(sp.get_piece_size())}
    return tuple(sorted(p for p in found if p.removeprefix(MARK).isalpha()))


class Pieces:
    """A trie over the pieces; finds every piece at every place of many words at once."""

    def __init__(self, pieces: tuple[str, ...]):
        self.pieces = pieces
        self.letter = {c: k + 1 for k, c in enumerate(sorted({c for p in pieces for c in p}))}
        width = len(self.letter) + 1
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, p in enumerate(pieces):
            at = 0
            for c in p:
                at = nodes[at].setdefault(self.letter[c], len(nodes))
                if at == len(nodes):
                    nodes.append({})
                    ends.append(-1)
            ends[at] = k
        # state 0 is dead, the root is 1
        self.ends = np.array([-1, *ends], np.int32)
        keys = np.array([((n + 1) * width + c, t + 1) for n, arcs in enumerate(nodes) for c, t in arcs.items()] or [(0, 0)], np.int64)
        keys = keys[np.argsort(keys[:, 0])]
        self.width, self.keys, self.to = width, keys[:, 0].copy(), keys[:, 1].astype(np.int32)
        self.dense = None
        if (len(nodes) + 1) * width <= 8_000_000:
            self.dense = np.zeros((len(nodes) + 1) * width, np.int32)
            self.dense[self.keys] = self.to
            self.dense[:width] = 0

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + letter
        if self.dense is not None:
            return self.dense[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (state > 0), self.to[at], 0)

    def lattice(self, part: list[str]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For words of one length, per place (the mark in front is one) and length - 1: which words have a piece there, and which piece."""
        size = len(part[0]) + 1
        get = self.letter.get
        codes = np.array([[get(c, 0) for c in MARK + w] for w in part], np.int32).T
        out = []
        for at in range(size):
            rows, state, arcs = np.arange(len(part)), np.ones(len(part), np.int32), []
            for k in range(size - at):
                state = self.step(state, codes[at + k][rows])
                alive = state > 0
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                ends = self.ends[state]
                hit = ends >= 0
                arcs.append((rows[hit], ends[hit]))
            out.append(arcs)
        return out


def by_length(found: list[str], most: int = 4096):
    """Groups of words of one length, of bounded size."""
    order = sorted(found, key=len)
    at = 0
    while at < len(order):
        end, room = at, max(1, min(most, CELLS // (len(order[at]) + 1)))
        while end < len(order) and end - at < room and len(order[end]) == len(order[at]):
            end += 1
        yield order[at:end]
        at = end


def _arcs(lattice: list, table: np.ndarray, n: int):
    """``place, length - 1, words, pieces, probabilities`` of all arcs in order; one letter is always possible."""
    for at, arcs in enumerate(lattice):
        single = np.zeros((n, table.shape[1]))
        if arcs:
            rows, ids = arcs[0]
            single[rows] = table[ids]
        single[single.max(axis=1) == 0] = UNKNOWN
        yield at, 0, slice(None), None, single
        for k, (rows, ids) in enumerate(arcs[1:], 1):
            if len(rows):
                yield at, k, rows, ids, table[ids]


def log_totals(lattice: list, table: np.ndarray, n: int) -> np.ndarray:
    """Logarithm of the sum over all segmentations, per word and language."""
    size = len(lattice)
    alpha = np.zeros((size + 1, n, table.shape[1]))
    alpha[0] = 1
    logs = np.zeros(alpha.shape[1:])
    for at, k, rows, _, p in _arcs(lattice, table, n):
        if k == 0 and at and at % RESCALE == 0:
            most = alpha[at:].max(axis=0)  # later places hold sums already
            alpha[at:] /= most
            logs += np.log(most)
        alpha[at + k + 1][rows] += alpha[at][rows] * p
    return logs + np.log(np.maximum(alpha[size], 1e-300))


def expected(pieces: Pieces, table: np.ndarray, found: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece per language, of words that occur ``counts`` [word, language] times."""
    total = np.zeros_like(table)
    row = {w: k for k, w in enumerate(found)}
    for part in by_length(found):
        lattice, n = pieces.lattice(part), len(part)
        size = len(lattice)
        alpha, beta = np.zeros((2, size + 1, n, table.shape[1]))
        alpha[0], beta[size] = 1, 1
        arcs = list(_arcs(lattice, table, n))
        for at, k, rows, _, p in arcs:
            alpha[at + k + 1][rows] += alpha[at][rows] * p
        for at, k, rows, _, p in reversed(arcs):
            beta[at][rows] += p * beta[at + k + 1][rows]
        share = counts[[row[w] for w in part]] / np.maximum(alpha[size], 1e-300)
        found_ids, uses = [], []
        for at, k, rows, ids, p in arcs:
            if ids is None:
                if not lattice[at]:
                    continue
                rows, ids = lattice[at][0]
                p = table[ids]
            found_ids.append(ids)
            uses.append(alpha[at][rows] * p * beta[at + k + 1][rows] * share[rows])
        if found_ids:
            every, use = np.concatenate(found_ids), np.concatenate(uses)
            for lang in range(table.shape[1]):
                total[:, lang] += np.bincount(every, use[:, lang], len(table))
    return total


class Model:
    def __init__(self, raw: bytes):
        spec = np.load(io.BytesIO(raw), allow_pickle=False)
        self.langs = [str(x) for x in spec["langs"]]
        self.table, self.prior = spec["table"], spec["prior"]
        self.pieces = Pieces(tuple(str(x) for x in spec["pieces"]))
        self.row: dict[str, int] = {}
        self.logs = np.zeros((MEMO, len(self.langs)))

    def learn(self, new: list[str]) -> None:
        for part in by_length(new):
            at = len(self.row)
            self.logs[at : at + len(part)] = log_totals(self.pieces.lattice(part), self.table, len(part))
            for w in part:
                self.row[w] = len(self.row)

    def logs_of(self, part: list[str]) -> np.ndarray:
        """Summed logarithms of words that are all in the memo."""
        return self.logs[np.fromiter(map(self.row.__getitem__, part), np.int64, len(part))].sum(axis=0)

    def ready(self, found: set[str]) -> None:
        new = {w for w in found if w not in self.row}
        if len(self.row) + len(new) > MEMO:
            self.row.clear()
            new = found
        self.learn(list(new))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The new words of many texts are learned together, so that arrays are long."""
        most = MEMO // 4
        totals: list[np.ndarray] = []
        empty: list[bool] = []
        group: list[list[str]] = []
        held: set[str] = set()

        def flush():
            self.ready(held)
            totals.extend(self.prior + self.logs_of(part) for part in group)
            group.clear()
            held.clear()

        for text in texts:
            found = words(text)
            empty.append(not found)
            if len(found) > most:
                flush()
                total = self.prior.copy()
                for at in range(0, len(found), most):
                    part = found[at : at + most]
                    self.ready(set(part))
                    total += self.logs_of(part)
                totals.append(total)
                continue
            group.append(found)
            held.update(found)
            if len(held) > most:
                flush()
        flush()
        langs, scores = [], []
        for total, none in zip(totals, empty):
            if none or not self.langs:
                langs.append(UND)
                scores.append(0.0)
                continue
            best = int(np.argmax(total))
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return langs, scores


@task_cache(2)
def model(name: str) -> Model:
    with open(local_path(name), "rb") as f:
        return Model(f.read())


def learning_rows(docs: DataFrame, per_lang: int) -> tuple[DataFrame, dict[str, int]]:
    """Rows with text and language that may be learned from, about ``per_lang`` of each, and the full counts."""
    known = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return known.limit(0).select("text", "lang"), sizes
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n))])
    unit = F.abs(F.xxhash64("doc_id", F.lit("langid")) % 1_000_000) / 1_000_000
    return known.where(unit < share[F.col("lang")]).select("text", "lang"), sizes


def learn(docs: DataFrame, vocab_path: str, per_lang: int = SAMPLE_PER_LANG, rounds: int = ROUNDS) -> str:
    """Learn piece probabilities; returns the name of the distributed model file.

    The driver holds one number per piece and language, never rows of the corpus.
    """
    spark = docs.sparkSession
    rows, sizes = learning_rows(docs, per_lang)
    langs = sorted(sizes)
    place = {lang: k for k, lang in enumerate(langs)}
    width = max(len(langs), 1)

    def count(slices):
        seen: Counter = Counter()
        for texts, marks in slices:
            for t, lang in zip(texts, marks):
                for w, n in Counter(words(t)).items():
                    if len(w) <= LEARN_WORD:
                        seen[w, lang] += n
        items = list(seen.items())
        for at in range(0, len(items), 20_000):
            part = items[at : at + 20_000]
            yield [w for (w, _), _ in part], [place[x] for (_, x), _ in part], [n for _, n in part]

    counted = cut_lineage(
        map_batches(rows, count, "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    )
    pieces = pieces_of(vocab_path)

    def uses(table: np.ndarray | None):
        name = None
        if table is not None:
            held = io.BytesIO()
            np.savez(held, table=table)
            name = distribute(spark, held.getvalue(), "pieces.npz")

        def expect(slices):
            trie = _trie(vocab_path)
            start = np.vstack([np.full((len(pieces), width), 1 / max(len(pieces), 1)), np.zeros((1, width))])
            now = start if name is None else np.load(local_path(name))["table"]
            total = np.zeros_like(now)
            each: dict[str, np.ndarray] = {}
            for found, marks, n in slices:
                for w, lang, k in zip(found, marks, n):
                    each.setdefault(w, np.zeros(width))[lang] += k
                if len(each) > LEARN_WORDS:
                    total += expected(trie, now, list(each), np.array(list(each.values())))
                    each = {}
            if each:
                total += expected(trie, now, list(each), np.array(list(each.values())))
            rows_, cols = np.nonzero(total)
            yield rows_.tolist(), cols.tolist(), total[rows_, cols].tolist()

        summed = map_batches(counted, expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        out = np.zeros((len(pieces) + 1, width))
        for r in summed.orderBy("piece", "lang").collect():
            out[r["piece"], r["lang"]] = r["n"]
        return out

    table = None
    for _ in range(rounds):
        total = uses(table)
        used = total.max(axis=1) > 0
        smooth = np.where(used[:, None], total + SMOOTH, 0)
        table = smooth / np.maximum(smooth.sum(axis=0, keepdims=True), 1e-12)
    used = np.flatnonzero(table.max(axis=1) > 0)
    counts = np.array([sizes[x] for x in langs] or [1.0], dtype=float)
    held = io.BytesIO()
    np.savez(
        held,
        langs=np.array(langs, dtype=str),
        pieces=np.array([pieces[k] for k in used], dtype=str),
        table=np.vstack([table[used], np.zeros((1, width))]),
        prior=np.log(counts / counts.sum()),
    )
    return distribute(spark, held.getvalue(), "langid.npz")


@task_cache(2)
def _trie(vocab_path: str) -> Pieces:
    return Pieces(pieces_of(vocab_path))


def predict(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (the language's posterior).

    Texts that are null or hold no letter get ``und`` and 0, as does every text if
    nothing could be learned.  Rows stay as they are; clashing columns are replaced.
    """
    return append(df, [text], lambda texts: model(name).predict(texts), "lang_pred string, score double")
