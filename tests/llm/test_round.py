"""Near vectors, hard negatives and collocations: brute force, edge cases and planted groups."""

import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from routeloom.llm import bpe, decontaminate, descent, jaccard, negatives, phrases, toxicity
from tests.llm.test_queries import SF


def brute_links(vectors, cosine):
    """Links and smallest reachable key of (key, label, vector) rows by comparing all."""
    unit = {}
    for n, (_, label, v) in enumerate(vectors):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            scaled = np.array(v) / max(map(abs, v))
            unit[n] = scaled / np.linalg.norm(scaled)
    links, root = Counter(), list(range(len(vectors)))
    for a, b in itertools.combinations(unit, 2):
        if vectors[a][1] == vectors[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
            links[a] += 1
            links[b] += 1
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    least = defaultdict(list)
    for n, r in enumerate(root):
        least[r].append(vectors[n][0])
    names = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return sorted((repr(v[0]), links[n], names[root[n]]) for n, v in enumerate(vectors))


def near(spark, vectors, **options):
    rows = [(k, label, v, 0, "x") for k, label, v in vectors]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, n_links int, component_id string")
    return descent.near_vectors(df, 0.93, **options).collect()


def test_near_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (3, 1, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 0, None), (6, 0, []),
        (7, 0, [0.0, 0.0]), (8, 0, [nan, 1.0]), (9, 0, [inf, 1.0]), (10, 0, [None, 1.0]), (11, 0, [1.0, 0.0, 0.0]),
        (12, 0, [1.0, 0.05, 0.0]), (2, 0, [1.0, 0.1]), (None, 0, [0.0, -3.0]), (13, 0, [-0.0, -1.0]), (14, 0, [1e300, 1e299]),
    ]
    got = near(spark, vectors)
    assert sorted((repr(r.vec_id), r.n_links, r.component_id) for r in got) == brute_links(vectors, 0.93)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert near(spark, []) == []


def test_near_vectors_dense_groups(spark):
    """Clusters far larger than a list, a chain of neighbours, copies of one vector, and noise."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x)
    vectors = []
    for size, spread in ((120, 0.02), (60, 0.06), (40, 0.004)):
        centre = unit(rng.normal(size=16))
        vectors += [unit(centre + rng.normal(size=16) * spread) for _ in range(size)]
    a, b = np.eye(16)[0], np.eye(16)[1]
    vectors += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 2.4, 0.02)]
    vectors += [vectors[0]] * 50 + [unit(x) for x in rng.normal(size=(200, 16))]
    rows = [(int(k), 0, v.tolist()) for k, v in zip(rng.permutation(len(vectors)), vectors)]
    got = near(spark, rows, k=5)
    assert sorted((repr(r.vec_id), r.n_links, r.component_id) for r in got) == brute_links(rows, 0.93)


def brute_negatives(rows, anchors, k=5):
    out = []
    for a, la, va in rows:
        if a not in anchors:
            continue
        score = lambda v: sum(x * y for x, y in zip(va, v))
        other = [(-score(v), b, lb) for b, lb, v in rows if b != a and len(v) == len(va)]
        for ps, p, _ in sorted(x for x in other if x[2] == la)[:k]:
            fit = sorted(x for x in other if x[2] != la and 80 * -ps <= 100 * -x[0] <= 100 * -ps)[:k]
            out += [(a, p, n, b, -ps, -s) for n, (s, b, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0, 3])
def test_negatives_by_brute_force(spark, monkeypatch, spread):
    """Small buckets; with close vectors the ranges prune, with ties the smaller key wins."""
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(spread)
    base = rng.integers(-40, 40, (6, 8))
    rows = [(int(k), int(rng.integers(0, 3)), (base[k % 6] + rng.integers(-spread - 1, spread + 2, 8)).tolist()) for k in range(150)]
    rows += [(500 + k, k % 2, [1, 2, 3]) for k in range(6)] + [(600, 0, []), (601, 1, []), (602, 0, [0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    got = negatives.mine(df, (df.vec_id % 10 == 0)).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, {r[0] for r in rows if r[0] % 10 == 0})


def test_pruning_keeps_what_scores_enough():
    rng = np.random.default_rng(1)
    values = rng.normal(size=(400, 8)).round(2) * 100
    bucket = negatives.Bucket(np.arange(400), np.zeros(400, int), values)
    asked = values[:50] + rng.normal(size=(50, 8))
    low = np.full((50, 1), 0.95) * (np.sqrt((asked**2).sum(1)) * bucket.longest)[:, None]
    block = negatives.Anchors(np.arange(50) + 1000, np.ones(50, int), asked, low, np.full((50, 1), np.inf), 5)
    dense, sparse = block.ranges(bucket, low[:, 0])
    reach = asked @ bucket.values.T >= low
    assert sparse and all(set(np.flatnonzero(reach[a])) <= set(rows) for a, rows in sparse.items())
    assert not any(reach[a].any() for a in set(range(50)) - set(dense) - set(sparse))


def test_negatives_edges(spark):
    schema = "vec_id long, label int, v array<long>, rank string, anchor int"
    rows = [(None, 0, [1], "r", 1), (10, None, [1], "r", 1), (20, 0, None, "r", 1), (30, 0, [None], "r", 1), (40, 0, [5], "r", 1), (40, 0, [5], "r", 1), (41, 0, [5], "r", 1), (42, 1, [4], "r", 1), (43, 1, [6], "r", 1)]
    df = spark.createDataFrame(rows, schema)
    assert list(map(tuple, negatives.mine(df, df.vec_id % 10 == 0).collect())) == [(40, 41, 1, 42, 25, 20)]
    assert negatives.mine(df.where("false"), df.vec_id % 10 == 0).collect() == []


def brute_phrases(docs, least=10, inside=50, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + 2] for p, a in found.items() if len(p) == 3 for i in (0, 1) if 100 * a >= inside * f[p[i : i + 2]]}
        rows = []
        for p, a in found.items():
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if p not in gone:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_collocations_by_brute_force(spark, monkeypatch):
    """Tiny shards, steps and ranges; words with zero bytes, controls and other scripts; ties."""
    rng = np.random.default_rng(2)
    words = ["a", "B", "ab", "é", "É", "中文", "\x00", "x\x1f", "c", " "]
    docs = [(lang, " ".join(rng.choice(words, 40)) + "," + "\t".join(rng.choice(words[:4], 30)) + "!\n") for lang in ("en", None, "und", "fr") for _ in range(12)]
    docs += [("en", None), ("en", ""), ("de", " \t.,"), ("fr", "A b c " * 3000), ("fr", "A b c " * 3000)]
    monkeypatch.setattr(phrases, "RANGE_BYTES", 4000)
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "lang string, text string, rank int, phrase string")
    got = phrases.collocations(df).collect()
    assert sorted(map(tuple, got)) == brute_phrases(docs)
    assert phrases.collocations(df.where("false")).collect() == []
    got = phrases.collocations(df, longest=2, top=3).groupBy("lang").count().collect()
    assert got and all(r["count"] <= 3 for r in got)


def test_transducer_counts_and_shares():
    rng = np.random.default_rng(3)
    words = [b"w%d" % k for k in rng.permutation(30)]
    rows = np.unique(rng.integers(0, 30, (600, 3)) % [30, 5, 4], axis=0)
    counts = rng.integers(1, 10**10, len(rows))
    place = phrases.byte_order(words)
    made = phrases.Transducer.load(phrases.compiled(words, place, rows, counts).dump())
    text = [tuple(words[k] for k in r) for r in rows.tolist()]
    want = dict(zip(text, counts.tolist()))
    got = [tuple(made.labels[k] for k in r) for r in made.grams().tolist()]
    assert got == sorted(want) and made.counts.tolist() == [want[g] for g in got]
    assert made.find([list(c) for c in zip(*got)]).tolist() == list(range(len(got)))
    assert made.find([[b"w1", b"none"], [b"none", b"w1"], [b"w1", b"w1"]]).tolist() == [-1, -1]
    prefixes = len({g[:1] for g in got}) + len({g[:2] for g in got}) + 2
    assert len(made.width) < prefixes  # equal ends are one state


def test_small_shards_give_the_same_counts(monkeypatch):
    """A buffer that flushes all the time holds the same n-grams, each counted once across steps."""
    text = b" ".join(b"w%d" % (k * k % 17) for k in range(500))
    shard = phrases.Shard("en", 3, np.full(8, 255, np.uint8))
    found = phrases.tokens([text])
    for at in range(0, len(found), 7):
        shard.add(found[at : at + 7 + 2])
    shard.settle()
    assert shard.counts[0].sum() == 498


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_collocations"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})")
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(rel.fetchall())


def test_embedding_query_is_whole(spark):
    got = entry.queries()["op11_embedding_near_dedup"](spark, SF)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    con = duckdb.connect()
    data = con.sql(f"SELECT vec_id, label, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    assert sorted((repr(r.vec_id), r.n_links, r.component_id) for r in got.collect()) == brute_links([(k, la, list(v)) for k, la, v in data], 0.93)


def test_merge_many_equals_merge():
    import public_tokenizers

    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(list(b"aabbceeth lino\xc3\xa9\xff"), rng.integers(0, 70)).astype("u1")) for _ in range(3000)]
    words += [b"", b"a", b" the", b"x" * 300, b"aaaaaaaaaa", b"thethethe"] + [b" internationalization"] * 2
    assert vocab.merge_many(words) == [np.array(vocab.merge(w), "<u4").tobytes() for w in words]
    assert vocab.merge_many([]) == []


def test_near_copies_with_repeated_and_null_keys(spark):
    a, b = "one two three four five six seven", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my"
    rows = [(1, a), (5, a), (5, b), (7, b + " nu"), (5, b), (None, a), (8, ""), (8, ""), (9, None), (None, None)]
    df = spark.createDataFrame([(*r, k, "e") for k, r in enumerate(rows)], "doc_id long, text string, n int, component string")
    got = sorted(((r.doc_id, r.text) for r in jaccard.drop_near_copies(df, 5, 80, 100).collect()), key=repr)
    assert got == sorted([(None, a), (5, b), (8, ""), (8, ""), (9, None), (None, None)], key=repr)
    unique = df.where("n in (0, 2, 3, 6)")
    assert sorted(r.doc_id for r in jaccard.drop_near_copies(unique, 5, 80, 100).collect()) == [1, 5, 8]
    assert jaccard.drop_near_copies(df.where("false"), 5, 80, 100).collect() == []


def test_nothing_learned_rejects_nothing(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "you idiot", "fine words here"] * 5)], "doc_id long, text string")
    for toxic in (None, 0, 1):
        labels = spark.createDataFrame([(k, 1, toxic) for k in range(20)], "doc_id long, quality int, toxic int")
        scored = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
        assert len(scored) == 20 and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in scored)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, empty)).where("predicted = 1").isEmpty()


def test_benchmark_rows_without_item_still_hit(spark):
    docs = spark.createDataFrame([(1, "so many words in a row")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "many words"), (3, "a row")], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).first()
    assert (got.n_hit, got["items"]) == (4, ["3"])
