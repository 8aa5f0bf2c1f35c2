"""A training corpus from documents, in five stages; each stage's output is written and read again.

Toxic documents go, one document of each near-duplicate group stays, personal data is replaced, sources are mixed to
their target weights, and the mix is encoded. Every stage takes all rows: null texts and ids, repeated rows and columns
of any name pass through it, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlore.llm import bpe, jaccard, mixing, pii, toxicity
from gridlore.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below one half; null and empty texts have the score of no hits. Columns stay."""
    return toxicity.keep_clean(spark, docs, sf_dir)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the least id; documents without words all stay. Columns stay."""
    return jaccard.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null. Columns stay, n_chars follows the text."""
    return pii.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once or twice, the last one cut. Columns stay; documents without words go."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (the bytes that the ids stand for) of every document."""
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned lexicons, shingle links and BPE merges can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
