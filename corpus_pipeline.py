"""A corpus pipeline of five stages over `documents`: language, quality, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe, language, mixing, ngram_join, quality
from tallyforge.llm.shared import table, written


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; `lang` is the predicted one. Null texts and texts without a letter go."""
    return language.labelled(docs)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.accepted(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.near_duplicate_representatives(docs)


def by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each pass over a document, with the part that the pass takes."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of the mix."""
    import public_tokenizers

    return bpe.token_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", by_language), ("quality", by_quality), ("near duplicates", without_near_duplicates), ("mixing", by_weight), ("token ids", token_ids)]

#: No SQL form: labels come from a fitted model and ids from a tokenizer. Tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
