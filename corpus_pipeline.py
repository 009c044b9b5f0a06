"""The corpus pipeline: quality classifier, exact dedup, MinHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of ``documents``; the last one returns the token ids of what is left.

Defined results of every stage: an empty table gives an empty table with the same columns; extra
columns pass through all stages but the last, whatever their names; rows that repeat in all
columns are treated alike. What a stage makes of nulls, empty texts and ties stands at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import bpe, exact, minhash, mixing, quality, util

#: Percent: documents that share so many of their five-word shingles are near copies.
NEAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    It learns from ``docs`` and the labels at ``sf_dir``, and scores every text by itself: null and
    empty texts get the score of a document without words, so they stay or go together. If there
    are not both kinds of labels there is no classifier, and every document stays.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays.

    Texts are equal after lower-casing A-Z; a null text counts as empty, a null doc_id as the
    smallest. Rows that repeat the doc_id and the text of the one that stays all stay; another
    text under the same doc_id is another document.
    """
    return exact.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: int = NEAR) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    ``threshold`` is the percentage of shared shingles. Texts without words and rows without
    doc_id are near copies of nothing and stay.
    """
    return minhash.drop_near_duplicates(docs, threshold=threshold)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks for, at most twice; whole ones only.

    A null source is a source of its own. Documents without words have no size and are not taken.
    A document of the second epoch is a second, equal row.
    """
    return mixing.apply_mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256 of every row; null and empty texts have no ids."""
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: SQL cannot express the classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    When a stage's rows are written, the scratch tables it needed and its input are removed.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with util.own_tables() as made:
            docs = util.materialize(stage(spark, docs, sf_dir))
            util.remove(spark, [*before, *made[:-1]])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
