"""Methods against slow enumerations: segmentations of words, leaves under edits."""

import itertools
import math
import random

import numpy as np
import pytest

from routeloom.llm import langid, merkle


def segmentations(word):
    marked = langid.MARK + word
    for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
        ends = [k + 1 for k, c in enumerate(cuts) if c] + [len(marked)]
        yield [marked[a:b] for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize("rescale", [2, 16])
def test_forward_sums_every_segmentation(monkeypatch, rescale):
    """Pieces of up to eleven letters, letters without a piece, a language without some pieces."""
    monkeypatch.setattr(langid, "RESCALE", rescale)
    rng = random.Random(1)
    pieces = sorted({langid.MARK, "abababababa", langid.MARK + "abab", *("".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(25)), "ü"})
    table = np.random.default_rng(2).random((len(pieces) + 1, 2)) * (np.random.default_rng(3).random((len(pieces) + 1, 2)) < 0.7)
    table[-1] = 0
    trie = langid.Pieces(tuple(pieces))
    place = {p: k for k, p in enumerate(pieces)}
    words = ["".join(rng.choice("abbüx") for _ in range(n)) for n in (1, 2, 5, 11, 12) for _ in range(4)] + ["ab" * 6]

    def chance(piece, lang):
        row = table[place[piece]] if piece in place else np.zeros(2)
        if len(piece) == 1 and row.max() == 0:
            return langid.UNKNOWN
        return row[lang]

    for part in langid.by_length(sorted(set(words))):
        got = langid.log_totals(trie.lattice(part), table, len(part))
        for word, row in zip(part, got):
            for lang in (0, 1):
                want = sum(math.prod(chance(p, lang) for p in cut) for cut in segmentations(word))
                assert row[lang] == pytest.approx(math.log(max(want, 1e-300)), abs=1e-9) or want == 0


def test_long_runs_are_scored_whole():
    trie = langid.Pieces((langid.MARK, "a", "aa", "b"))
    table = np.array([[0.1], [0.2], [0.3], [0.4], [0.0]])
    part = ["a" * 5000]
    # one letter on: 0.2 of one piece, 0.3 of two letters
    a, b = 1.0, 0.2
    logs = math.log(0.1)
    for _ in range(4999):
        a, b = b, 0.2 * b + 0.3 * a
        logs, a, b = logs + math.log(b), a / b, 1.0
    got = langid.log_totals(trie.lattice(part), table, 1)[0, 0]
    assert got == pytest.approx(logs, rel=1e-9)


def test_expected_uses_by_enumeration():
    pieces = (langid.MARK, langid.MARK + "a", "a", "ab", "b", "ba")
    table = np.vstack([np.linspace(0.1, 0.6, 6)[:, None], [[0.0]]])
    trie, word = langid.Pieces(pieces), "abab"
    want, total = np.zeros(6), 0.0
    for cut in segmentations(word):
        if all(p in pieces for p in cut):
            p = math.prod(table[pieces.index(x), 0] for x in cut)
            total += p
            for x in cut:
                want[pieces.index(x)] += p
    got = langid.expected(trie, table, [word], np.array([[3.0]]))
    assert got[:6, 0] == pytest.approx(3 * want / total)


TEXTS = {
    "words": " ".join(f"word{k * 7919 % 613}" for k in range(200)),
    "unspaced": "".join(chr(0x4E00 + k * 7919 % 3000) for k in range(400)),
    "one letter": "x" * 3000,
}


@pytest.mark.parametrize("kind", TEXTS)
def test_leaves_line_up_behind_an_edit(kind):
    text = TEXTS[kind]
    assert "".join(merkle.leaves(text)) == text
    assert max(map(len, merkle.leaves(text))) <= merkle.LONGEST
    same = merkle.tree(text)
    for edited in ("new " + text, text[:50] + "Z" + text[50:], text + "!"):
        assert merkle.likeness(same, merkle.tree(edited)) > 0.85
    half = merkle.likeness(same, merkle.tree(text[: len(text) // 2] + "".join(chr(0x3041 + k * 31 % 80) for k in range(len(text) // 2))))
    assert 0.2 < half < 0.7
    assert merkle.likeness(same, merkle.tree("".join(chr(0x0400 + k * 37 % 200) for k in range(400)))) < 0.1
    assert merkle.likeness(same, merkle.load(merkle.dump(same))) == 1.0


def test_likeness_is_the_share_of_common_leaves():
    """Against a plain count of leaves, on texts of several sections that share paragraphs."""
    rng = random.Random(5)
    paragraphs = [" ".join(rng.choice(["red", "green", "blue", "one", "two"]) + str(rng.randint(0, 99)) for _ in range(12)) for _ in range(8)]
    for _ in range(20):
        a, b = ("\n\n".join("\n".join(rng.choice(paragraphs) for _ in range(2)) for _ in range(3)) for _ in range(2))
        from collections import Counter

        x, y = (Counter(leaf for line in t.replace("\n\n", "\n").split("\n") for leaf in merkle.leaves(line)) for t in (a, b))
        plain = 2 * (x & y).total() / (x.total() + y.total())
        got = merkle.likeness(merkle.tree(a), merkle.tree(b))
        assert got == 1.0 if a == b else 0 <= got <= plain + 1e-9
    assert merkle.tree(None) == merkle.tree("") and merkle.likeness(merkle.tree(""), merkle.tree("a")) == 0.0


def test_leaves_of_a_text_are_those_of_its_lines():
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice("ab c\n\nxyz é中\n") for _ in range(rng.randint(1, 400)))
        lines = [leaf for part in text.split("\n\n") for line in part.split("\n") for leaf in merkle.leaves(line)]
        hashed = [merkle.xxhash.xxh32_hexdigest(leaf.encode("utf-32-le")) for leaf in lines]
        assert [r for _, ps in merkle.tree(text)[1] for _, rs in ps for r in rs] == hashed
