import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from routeloom.functions import text as tx
from routeloom.operators import similarity, vectors


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(120):
        g = "big" if i < 90 else "small"
        centre = np.eye(6)[i % 3] * 4
        x = centre + rng.normal(size=6) * 0.3
        x /= np.linalg.norm(x)
        data.append((i, g, [float(v) for v in x]))
    return spark.createDataFrame(data, "id int, g string, v array<double>").cache()


@pytest.mark.parametrize("block", [16, 4096])
def test_diversity_against_all_pairs(vecs, block):
    got = {r.g: r for r in vectors.cosine_diversity(vecs, "g", "id", "v", block=block).collect()}
    by_group = {}
    for r in vecs.collect():
        by_group.setdefault(r.g, []).append(r.v)
    for g, rows_ in by_group.items():
        x = np.array(rows_)
        sims = [float(x[i] @ x[j]) for i in range(len(x)) for j in range(i)]
        want = {"mean": np.mean(sims), "median": np.median(sims), "p95": np.quantile(sims, 0.95), "max": max(sims)}
        for c, value in want.items():
            assert got[g][c] == pytest.approx(value, abs=1e-9), (g, c)


def test_mixture_plans_agree_and_find_three_groups(vecs):
    one = vectors.group_mixture(vecs, "g", "id", "v", ks=(2, 3, 4), max_iter=15)
    many = vectors.group_mixture(vecs, "g", "id", "v", ks=(2, 3, 4), max_iter=15, limit=20)
    a = {(r.g, r.k): r for r in one.collect()}
    b = {(r.g, r.k): r for r in many.collect()}
    assert a.keys() == b.keys()
    for key in a:
        assert a[key].bic == pytest.approx(b[key].bic, rel=1e-3), key
        assert len(a[key].means) == key[1]
        assert sum(a[key].weights) == pytest.approx(1.0)
    best = {r.g: r.k for r in vectors.bic_select(one, "g").collect()}
    assert best["big"] in (3, 4)
    means = vectors.unit_means(vectors.bic_select(one, "g"), "g")
    for r in means.collect():
        assert np.linalg.norm(r.mean) == pytest.approx(1.0)
    medoids = vectors.distinct_medoids(vecs, means, "g", "id", "v")
    assert medoids.count() == means.count()
    assert medoids.select("g", "id").distinct().count() == means.count()


def test_groups_below_the_smallest_k_stay(spark):
    rng = np.random.default_rng(4)
    data = [(g, k, rng.normal(size=3).tolist()) for g, n in (("one", 1), ("two", 2), ("some", 600), (None, 5)) for k in range(n)]
    df = spark.createDataFrame(data, "g string, id int, v array<double>")
    fits = vectors.group_mixture(df, "g", "id", "v", ks=(2, 3), max_iter=3)
    got = {(r.g, r.k): (r.n, r.fitted) for r in fits.collect()}
    assert got == {
        ("one", 0): (1, False), ("two", 2): (2, True), ("some", 2): (600, True), ("some", 3): (600, True), (None, 2): (5, True), (None, 3): (5, True),
    }
    best = {r.g: r for r in vectors.bic_select(fits, "g").collect()}
    assert best.keys() == {"one", "two", "some", None}
    assert (best["one"].bic, best["one"].means, best["one"].converged) == (None, [], False)


def test_likelihood_never_falls():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(40, 3)), rng.normal(size=(40, 3)) + 4])
    w, mu, var = np.full(2, 0.5), x[:2], np.tile(x.var(axis=0), (2, 1))
    last = -np.inf
    for _ in range(20):
        nk, s1, s2, ll = vectors._expect(x, w, mu, var)
        assert ll >= last - 1e-6
        last = ll
        w, mu, var = vectors._maximise(nk, s1, s2, len(x), 1e-6)


def test_ties_take_fewer_components(spark):
    fits = spark.createDataFrame([("g", 3, 1.0), ("g", 2, 1.0), ("g", 4, 2.0)], "g string, k int, bic double")
    assert vectors.bic_select(fits, "g").first().k == 2


def test_medoid_falls_back_when_all_are_used(spark):
    df = spark.createDataFrame([("g", 1, [1.0, 0.0])], "g string, id int, v array<double>")
    means = spark.createDataFrame([("g", 0, [1.0, 0.0]), ("g", 1, [0.0, 1.0])], "g string, component int, mean array<double>")
    got = vectors.distinct_medoids(df, means, "g", "id", "v")
    assert rows(got, "component", "id") == [(0, 1), (1, 1)]


def test_nearest_over_small_blocks(vecs):
    one = vectors.nearest_in_group(vecs, "g", "id", "v", 0.9)
    many = vectors.nearest_in_group(vecs, "g", "id", "v", 0.9, block=13)
    assert rows(one, "id", "best_key", "n_above") == rows(many, "id", "best_key", "n_above")


def test_encoder_is_injected(spark):
    def encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id int, t string")
    got = {r.id: r.e for r in vectors.embed_texts(df, "t", "e", encoder, instruction="q: ").collect()}
    assert got[1] == pytest.approx([5 / 26**0.5, 1 / 26**0.5], abs=1e-6)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_pair_audit_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(similarity, "BLOCK_SETS", 256 if seed == 1 else 3)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    data = []
    for g in range(4):
        base = r.sample(words, 9)
        for i in range(14):
            pick = set(base) if g < 2 else set(r.sample(words, r.randrange(0, 12)))
            for _ in range(r.randrange(3)):
                pick ^= {r.choice(words)}
            data.append((g, i, sorted(pick)))
    df = spark.createDataFrame(data, "g int, i int, w array<string>")
    got = {r.g: r for r in similarity.pair_audit(df, "g", "i", "w").collect()}
    for g in range(4):
        sets = [set(w) for h, _, w in data if h == g]
        sims = [jaccard(a, b) for n, a in enumerate(sets) for b in sets[n + 1 :]]
        assert got[g].pairs == len(sims)
        assert got[g].high_pairs == sum(s >= 0.8 for s in sims)
        assert got[g].max_jaccard == pytest.approx(max(sims))


def test_empty_sets_are_equal(spark):
    df = spark.createDataFrame([([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(tx.token_jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
