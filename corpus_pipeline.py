"""Corpus pipeline: five stages from raw documents to encoded training text.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; its
result is stored as Parquet in the shared folder and read back as the next one's input.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from routeloom.llm import bpe, decontaminate, jaccard, pii, toxicity
from routeloom.llm.common import table
from routeloom.session import forget_later, shared_dir

#: Near copies: word 5-grams at a Jaccard similarity of 0.8.
COPY_WIDTH, COPY_NUM, COPY_DEN = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a score below 0.5; the grammar is learned from labelled documents of this stage."""
    spec = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, spec).where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each group of near copies; see ``jaccard.drop_near_copies`` for repeated ids."""
    return jaccard.drop_near_copies(docs, COPY_WIDTH, COPY_NUM, COPY_DEN)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no window of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind; n_chars follows the new text."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids; a text that does not decode to itself ends the run."""
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.recode(docs, vocab)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    checked = F.when(same, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a text does not decode to itself")).cast("long"))
    return coded.select("doc_id", "lang", "source", checked.alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: Learned scores and BPE are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is a table in the shared folder.

    Null and empty texts are neither toxic, copies nor contaminated: they come out with no
    tokens.  Documents with the same text but different ids are copies, documents with the
    same id but different texts are not.  An empty table gives an empty result.  The tables
    are entered for ``session.drop_scratch``.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        forget_later(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
