"""A corpus from raw documents to packed sequences: each stage works on all rows that the one before it kept.

Every stage takes any number of rows, none too. A null text counts as empty: it has no lines, and its score is the share of
good documents in training; null and empty texts are one group of exact copies; they are near to nothing else, have
size 0 in the mix, which never takes them, and are one token in packing. Rows that repeat id and text are one row after
the exact stage. Of very long texts all is read. Columns beyond those of documents are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import _run, exact_dedup, mixing, packing, quality_crf, queries, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from labels of ``sf_dir`` outside the held-out fold."""
    return quality_crf.keep_good(docs, queries.quality_model(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows each."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, each with its sequence and place. Rows that the mix repeats are pieces of their own."""
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: A trained classifier, seeded hashes and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _run.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = _run.cut(docs)
    return docs
