import public_tokenizers

from routeloom.llm import bpe


def test_lexicon_counts_every_row(spark, monkeypatch):
    seen = []
    count = bpe.word_counts
    monkeypatch.setattr(bpe, "word_counts", lambda df, *more: seen.append(df.count()) or count(df, *more))
    df = spark.range(60_000).selectExpr("concat('w', id % 50) AS text")
    bpe.build_lexicon(df, public_tokenizers.path("byte_bpe_50k.json"), size=40)
    assert seen == [60_000]
