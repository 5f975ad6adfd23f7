"""Five stages over documents: quality classifier, language ID, n-gram Jaccard join, secret scans, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import jaccard, kneserney, language, packing, secrets
from strandline.llm.common import written
from strandline.llm.queries import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit; the others go."""
    return kneserney.keep_quality(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with confidence; the others go."""
    return language.keep_known(docs, language.fit_language(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a similarity of 0.8 or more)."""
    return jaccard.one_of_each(docs, size=5, share=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind in brackets."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier), ("language ID", language_id), ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scan), ("packing", pack)
]

#: The first two stages train models and the last packs by split, which SQL can't express; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
