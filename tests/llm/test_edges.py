"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import public_tokenizers
import pytest

from routeloom.llm import bpe, decontaminate, license, merkle, pii, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, score string, ids int, items string, pii int, n_tokens string"
TEXTS = [None, "", "plain", "plain", "x" * 30_000, "MIT License and a@b.org 10.0.0.1", "é\n\n\nü"]


@pytest.fixture(params=[TEXTS, []], ids=["rows", "empty"])
def docs(spark, request):
    rows = [(None if k == 2 else k, t, "s", 1, "i", 2, "n") for k, t in enumerate(request.param)]
    return spark.createDataFrame(rows + rows[3:4], SCHEMA)


def test_every_row_operator_keeps_rows(spark, docs):
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    n = docs.count()
    bench = spark.createDataFrame([(1, "plain"), (2, None), (None, "plain"), (3, "")], "item_id long, text string")
    spec = '{"terms": ["plai*"], "weights": [3, 3, 0, 0, 1, 3, -2.0]}'
    coded = bpe.decode(bpe.encode(docs, vocab), vocab).collect()
    assert len(coded) == n and all(r["decoded"] == (r["text"] or "") for r in coded)
    hit = decontaminate.decontaminate(docs, bench).collect()
    assert len(hit) == n and all((r["n_hit"] > 0) == (r["text"] == "plain") for r in hit)
    parts = decontaminate.decontaminate(docs, bench.union(spark.createDataFrame([(4, "mit license")], "item_id long, text string")), shard_bytes=8)
    assert parts.where("n_hit > 0").count() == sum((r["text"] or "")[:5] in ("plain", "MIT L") for r in coded)
    assert pii.find_pii(docs).count() == n
    assert all("@" not in (r["text"] or "") for r in pii.mask_pii(docs).collect())
    assert all(r["predicted"] == (r["text"] == "plain") for r in toxicity.score(docs, spec).collect())
    assert license.scan_licenses(docs).count() == n
    assert tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256, block_bytes=64).count() == n
    assert merkle.compare_edited(docs).count() == n


def test_small_blocks_and_segments(spark, tmp_path):
    rows = [(1, "u", "a" * 5000), (2, None, "a" * 5000), (3, "u\nv", None), (4, "u", "é" * 60), (None, "u", "é" * 60), (6, "u", "WARC/1.1\r\n\r\n" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), segment=700, chunk=64, per_file=3)
    got = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert all(r["error"] is None for r in got.values()) and len(got) == 6
    assert (got["2"]["kind"], got["2"]["refers_to"], got["2"]["n"]) == ("revisit", "1", 5000)
    assert bytes(got["6"]["payload"]).decode() == rows[5][2] and got["3"]["n"] == 0
    assert got[None]["refers_to"] == "4"
