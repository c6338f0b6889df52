"""Toxicity by a weighted finite-state pattern grammar over clauses.

Terms (words, or stems as ``abc*``) are learned from labelled rows.  A clause's words
become symbols: insult, threat, target, negation, reported speech, other.  Four
transducers are composed over them: negation turns a following insult into a denied
one, reported speech into a quoted one, a target beside it into an aimed one, and a
threat with a target into an aimed threat.  The final symbols of all clauses are
counted and weighed by a logistic model, learned from the same rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from routeloom.llm.common import append, held_out, map_batches, task_cache
from routeloom.session import cut_lineage

#: Expected number of labelled rows the grammar is fitted on; the only bound.
SAMPLE_ROWS = 20_000
STEM_LENGTHS = (4, 5, 6, 7)
MAX_TERMS = 2_000
LEAST_PRECISION = 0.9

# Words of the grammar's other classes, in the languages of the corpus.
THREATS = "kill hurt destroy shoot stab beat burn punish töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yourself they them he she him du dich dein ihr euch sie tu toi vous ton ils te ti usted tú ellos".split()
NEGATIONS = "not no never isn't aren't without nicht kein keine nie ne pas jamais sans nunca sin jamás".split()
REPORTS = "said says called wrote quoted claimed sagte nannte schrieb dit appelé écrit dijo llamó escribió".split()

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CLAUSE = re.compile(r"[^.!?;\n]+")
OUTPUTS = ("insult", "aimed", "denied", "quoted", "threat", "aimed_threat")


class Transducer:
    """A deterministic transducer with a weight on each arc: (state, symbol) -> (state, output, weight).

    A symbol without an arc of its own follows the state's default, which copies it.
    """

    def __init__(self, arcs: dict, default: dict):
        self.arcs, self.default = arcs, default

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            arc = (self.default.get(state, 0), symbol, 0.0)
        return arc


def _window(trigger: str, change: dict[str, str], reach: int) -> Transducer:
    """After ``trigger``, symbols of ``change`` are rewritten for ``reach`` words."""
    arcs = {(s, trigger): (reach, trigger, 0.0) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        for symbol, out in change.items():
            arcs[s, symbol] = (s - 1, out, 1.0)
    return Transducer(arcs, {s: s - 1 for s in range(1, reach + 1)})


NEGATION = _window("N", {"I": "D"}, 2)
REPORT = _window("R", {"I": "Q"}, 4)
AIM = _window("Y", {"I": "A", "T": "H"}, 3)
CASCADE = (NEGATION, REPORT, AIM)
_NAMES = {"I": 0, "A": 1, "D": 2, "Q": 3, "T": 4, "H": 5}


@task_cache(100_000)
def composed(states: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str, float]:
    """One step of the composition: each transducer reads what the one before it writes."""
    after, weight = [], 0.0
    for machine, state in zip(CASCADE, states):
        state, symbol, w = machine.step(state, symbol)
        after.append(state)
        weight += w
    return tuple(after), symbol, weight


def clause_counts(symbols: list[str]) -> Counter:
    states: tuple[int, ...] = (0,) * len(CASCADE)
    out: Counter = Counter()
    for s in symbols:
        states, final, _ = composed(states, s)
        if final in _NAMES:
            out[final] += 1
    return out


class Grammar:
    """Learned terms and weights; ``score`` reads the text alone."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        self.weights = model["weights"]
        self.whole = {t for t in model["terms"] if not t.endswith("*")} | set()
        self.stems = tuple(t[:-1] for t in model["terms"] if t.endswith("*"))
        self.lengths = sorted({len(s) for s in self.stems})
        self.stem_set = set(self.stems)
        self.classes = {w: "Y" for w in TARGETS} | {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS} | {w: "T" for w in THREATS}
        self.search = ahocorasick.Automaton()
        for t in {*self.whole, *self.stems, *THREATS}:
            self.search.add_word(t, len(t))
        self.search.make_automaton()

    def symbol(self, word: str) -> str:
        if word in self.whole or any(word[:n] in self.stem_set for n in self.lengths):
            return "I"
        return self.classes.get(word, "O")

    def features(self, text: str | None) -> tuple[int, ...]:
        """Counts (three at most) of each final symbol over the clauses that hold an insult or a threat."""
        counts: Counter = Counter()
        low = (text or "").lower()
        done = 0
        for end, size in self.search.iter(low):
            begin = end - size + 1
            if begin < done or (begin and low[begin - 1].isalnum()):
                continue
            clause_at = max(low.rfind(c, done, begin) for c in ".!?;\n") + 1 or done
            m = _CLAUSE.match(low, max(clause_at, done))
            clause = m[0] if m else low[begin : end + 1]
            done = m.end() if m else end + 1
            counts += clause_counts([self.symbol(w) for w in _WORD.findall(clause)])
        return tuple(min(counts[k], 3) for k in _NAMES)

    def score(self, text: str | None) -> float:
        z = self.weights[-1] + sum(w * f for w, f in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@task_cache(2)
def grammar(spec: str) -> Grammar:
    return Grammar(spec)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """``text, toxic`` of about ``sample`` labelled learning rows, chosen by a hash of the id.

    A document labelled more than once is toxic if any label says so; unlabelled rows,
    null ids and null labels teach nothing.
    """
    known = (
        labels.select(F.col("doc_id"), F.col("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    unit = F.abs(F.xxhash64("doc_id", F.lit("toxicity")) % 1_000_000) / 1_000_000
    picked = known.where(unit < share) if share < 1 else known
    # The side is bounded by the sample parameter, whatever the corpus holds.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")


def term_counts(rows: DataFrame) -> DataFrame:
    """``term, pos, neg, contexts``: rows of each label that hold a word or stem, and how varied the word before it is.

    Contexts are a bit for each hash of the preceding word, so copies of a text count once.
    """

    def count(slices):
        pos, neg, seen = Counter(), Counter(), defaultdict(int)
        for texts, marks in slices:
            for text, toxic in zip(texts, marks):
                before, terms = "", set()
                for word in _WORD.findall((text or "").lower()):
                    forms = [word, *(word[:n] + "*" for n in STEM_LENGTHS if len(word) >= n)]
                    terms.update(forms)
                    if toxic:
                        bit = 1 << xxhash.xxh32_intdigest(before) % 62
                        for f in forms:
                            seen[f] |= bit
                    before = word
                (pos if toxic else neg).update(terms)
        every = list(pos.keys() | neg.keys())
        for at in range(0, len(every), 20_000):
            part = every[at : at + 20_000]
            yield part, [pos[t] for t in part], [neg[t] for t in part], [seen[t] for t in part]

    found = map_batches(rows.select("text", (F.col("toxic") > 0).alias("toxic")), count, "term string, pos long, neg long, mask long")
    return found.groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bit_count(F.bit_or("mask")).alias("contexts")
    )


def choose_terms(candidates: list[tuple[str, int, int, int]]) -> list[str]:
    """Shortest stems first; a longer stem or word below a chosen stem adds nothing."""
    chosen: list[str] = []
    stems: set[str] = set()
    for term, *_ in sorted(candidates, key=lambda c: (not c[0].endswith("*"), len(c[0]), c[0])):
        word = term.rstrip("*")
        if any(word[:n] in stems for n in range(1, len(word) + 1)):
            continue
        chosen.append(term)
        if term.endswith("*"):
            stems.add(word)
    return chosen


#: Log-odds of every text while nothing is learned.
NOTHING_LEARNED = -20.0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> str:
    """Fit the grammar on learning rows; the model is a short JSON text.

    Terms must be toxic in ``LEAST_PRECISION`` of their rows and stand after so many
    different words that chance among all terms is unlikely.  Labels that are null teach
    nothing.  Without toxic rows, without clean rows or without any such term nothing is
    learned: every score is then close to 0 and no text is toxic.
    """
    rows = cut_lineage(training_rows(docs, labels, sample))
    size = {bool(r["t"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = size.get(True, 0), size.get(False, 0)
    rate = (n_pos + 1) / (n_pos + n_neg + 2)
    terms: list[str] = []
    if n_pos and n_neg:
        least = max(2, math.ceil(16 / math.log(1 / min(rate, 0.5))))
        good = term_counts(rows).where((F.col("contexts") >= least) & (F.col("pos") >= LEAST_PRECISION * (F.col("pos") + F.col("neg"))))
        top = good.orderBy(F.desc("contexts"), F.desc("pos"), "term").limit(MAX_TERMS).collect()
        terms = choose_terms([tuple(r) for r in top])
    start = {"terms": terms, "weights": [0.0] * len(OUTPUTS) + [math.log(rate / (1 - rate)) if terms else NOTHING_LEARNED]}
    if not terms:
        return json.dumps(start)
    spec = json.dumps(start)
    marked = append(rows, ["text"], lambda texts: [[list(grammar(spec).features(t)) for t in texts]], "f array<int>")
    # at most 4^6 kinds of rows, whatever the sample
    kinds = marked.groupBy("f", (F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()
    x = np.array([[*r["f"], 1.0] for r in kinds])
    y = np.array([float(r["t"]) for r in kinds])
    n = np.array([float(r["n"]) for r in kinds])
    start["weights"] = fit(x, y, n).tolist()
    return json.dumps(start)


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic weights by Newton steps over counted rows."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + keep * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(df: DataFrame, spec: str, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    A null or empty text gets the score of a text without any pattern.  Rows stay as they
    are; columns called like the new ones are replaced.
    """

    def run(texts):
        model = grammar(spec)
        scores = [model.score(t) for t in texts]
        return scores, [int(s >= 0.5) for s in scores]

    return append(df, [text], run, "score double, predicted int")
