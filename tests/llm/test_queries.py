"""Registered corpus queries against SQL and brute-force versions on the smallest tables."""

import hashlib
import os
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from routeloom.llm import license, toxicity

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def data():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(data):
    return dict(data.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def run(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, SF).collect()]


@pytest.mark.parametrize("name", ["op2_ngram_jaccard", "op6_decontamination", "op8_warc"])
def test_matches_sql(spark, data, name):
    df = entry.queries()[name](spark, SF)
    got = sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    rel = data.sql(f"SELECT * FROM ({entry.oracle_sql()[name]})")
    want = sorted(rel.select(*[duckdb.ColumnExpression(c) for c in sorted(df.columns)]).fetchall())
    assert got == want


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_bpe_equals_library(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in run(spark, "op1_bpe_codec")}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert got[k]["decoded_sha256"] == sha(tok.decode(ids, skip_special_tokens=False))


def plain_pii(t):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    out = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return out


def test_pii_base_spans(spark, texts):
    for r in run(spark, "op4_pii"):
        want = plain_pii(texts[r["doc_id"]])
        for kind, found in want.items():
            assert r[f"n_{kind}"] == len(found)
        every = sorted((a, list(want).index(k), f"{k}:{a}:{b}") for k, f in want.items() for a, b in f)
        assert r["base_sha256"] == sha(",".join(x[2] for x in every))
        assert {x[2] for x in every} <= set(r["spans"].split(",")) | {""}


def test_license_scan(spark, texts):
    low = str.maketrans(license.UPPER, license.LOWER)
    got = run(spark, "op7_license_scan")
    assert len(got) == len(texts)
    for r in got:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(low))
        places, labels = [], set()
        for t in license.PHRASES:
            p = t.text.split()
            places += (found := [k for k in range(len(words)) if words[k : k + len(p)] == p])
            labels |= {t.label} if found else set()
        more = set()
        for t in license.TEXTS:
            need = -(-4 * len(t.tokens) // 5)
            blocks = [set(words[k : k + 64]) for k in range(0, len(words), 32)]
            more |= {t.label} if any(len(b & set(t.tokens)) >= need for b in blocks) else set()
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted(labels))
        assert r["labels"] == ",".join(sorted(labels | more))
        assert (r["score"] > 0) == bool(labels | more)


def test_token_counts(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in run(spark, "op9_token_counts")}
    assert got == {k: len(tok.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}


def test_fingerprints(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op10_merkle_fingerprint")}
    order = sorted(texts)
    seen = {}
    better = 0
    for k, after in zip(order, order[1:] + order[:1]):
        t, n, r = texts[k], texts[after], got[k]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        for text, f in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert seen.setdefault(text, f) == f
        assert r["near_next"] == 1.0 if t == n else r["near_next"] < 1
        better += r["near_edited"] > r["near_next"]
    assert len(set(seen.values())) == len(seen)
    assert better > 0.95 * len(order)


def test_language_and_toxicity_held_out(spark, data):
    langs = dict(data.sql("SELECT doc_id, lang FROM documents").fetchall())
    found = [r for r in run(spark, "op5_language_id") if r["held_out"]]
    assert found and sum(r["lang_pred"] == langs[r["doc_id"]] for r in found) > 0.9 * len(found)
    scores = run(spark, "op3_toxicity")
    assert len(scores) == len(langs) and all(0 <= r["score"] <= 1 for r in scores)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in scores)
    assert toxicity.SAMPLE_ROWS > 0


def test_pipeline(spark, data, texts):
    """The stages, one after another, against plain versions of their rules on the same learned grammar."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spec = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    grammar = toxicity.Grammar(spec)
    kept = {k: t for k, t in texts.items() if grammar.score(t) < 0.5}

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.encode().lower().decode())
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets, root = {k: grams(t) for k, t in kept.items()}, {k: k for k in kept}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    kept = {k: t for k, t in kept.items() if find(k) == k}
    hits = dict(data.sql(f"SELECT doc_id, contaminated FROM ({entry.oracle_sql()['op6_decontamination']})").fetchall())
    kept = {k: t for k, t in kept.items() if not hits[k]}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in run(spark, "pipeline")}
    assert got.keys() == kept.keys()
    for k, t in kept.items():
        if not any(plain_pii(t).values()) and not re.search("[0-9]{8}", t):
            assert got[k]["ids"] == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            assert not any(plain_pii(tok.decode(np.frombuffer(got[k]["ids"], "<u4").tolist(), skip_special_tokens=False)).values())
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "pii", "bpe"]
