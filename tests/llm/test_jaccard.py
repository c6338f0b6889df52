"""Signature trees and the join against brute force, with small chunks, ties, nulls and hot groups."""

import random

import numpy as np
import pytest

from routeloom.llm import jaccard


def brute(rows, width, num, den):
    sets = [set(jaccard.shingles(t, width).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)] = min(key, least.get(find(k), key))
    return sorted((key is None, key or 0, len(s), least.get(find(k))) for k, ((key, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 9, 40, 120]))] for _ in range(8)]
    rows = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.3:
            words += passage
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (3, rows[5][1]), (5, rows[5][1]), (None, rows[1][1]), (n + 3, "x" * 50_000)]


@pytest.mark.parametrize("chunk, width, num", [(256, 3, 90), (4, 3, 90), (4, 5, 80)])
def test_join_equals_brute_force(spark, monkeypatch, chunk, width, num):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "LOCALLY_COMMON", 10**9 if chunk == 4 else 4)
    rows = corpus(chunk + num, 160)
    df = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, component string").repartition(5)
    found = jaccard.link_sets(df, width, num, 100)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component"]) for r in found.collect())
    assert got == brute(rows, width, num, 100)


@pytest.mark.parametrize("bits", [1, 64, 1 << 23])
def test_a_block_has_one_text_of_a_class(spark, monkeypatch, bits):
    """Whatever the bitmap lets through, and however often a key is repeated."""
    monkeypatch.setattr(jaccard, "BLOOM_BITS", bits)
    sent, links = [], jaccard._links

    def counted(rows, *rest):
        sent.extend(tuple(r) for r in rows.groupBy("block", "cls").count().collect())
        return links(rows, *rest)

    monkeypatch.setattr(jaccard, "_links", counted)
    rows = corpus(11, 60)
    hot = rows[2][1] + " " + " ".join(f"h{k}" for k in range(60))
    rows += [(7, hot)] * 40 + [(k, hot) for k in range(100, 140)] + [(200, hot + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = jaccard.link_sets(df, 3, 90, 100)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component"]) for r in found.collect())
    assert got == brute(rows, 3, 90, 100)
    assert sent and {n for _, _, n in sent} == {1}


def test_a_text_without_key_links_others(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (None, " ".join(words[4:] + ["a", "b", "c", "d"])), (2, " ".join(words[8:] + [*"abcdefgh"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.link_sets(df, 3, 90, 100).select("doc_id", "component")
    assert {tuple(r) for r in found.collect()} == {(1, 1), (None, 1), (2, 1)}


def test_empty_table(spark):
    assert jaccard.link_sets(spark.createDataFrame([], "doc_id long, text string"), 3, 90, 100).collect() == []


def test_tree_prunes_only_impossible_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64))
        sets = []
        for _ in range(25):
            keep = base[rng.random(len(base)) < rng.choice([0.5, 0.95, 1.0])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(0, 12)).astype(np.uint64)])))
        tree = jaccard.SignatureTree([len(h) for h in sets], [jaccard.signature(h) for h in sets], 90, 100, sets)
        found = {frozenset(p) for p in tree.pairs()}
        for i in range(len(sets)):
            for j in range(i):
                if tree.linked(sets[i], sets[j]):
                    assert frozenset((i, j)) in found
