"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, personal data, tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last keep the columns of
documents. Stages judge whole texts, each on its own input. Stages that hand texts to Python set the
session's Arrow batches to at most TEXT_ROWS rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import bpe, decontam, pii, quality, simhash
from tallyline.llm.common import materialise, small_batches, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from labels outside the held-out third.

    Null and empty texts are judged like any other (as texts without words), rows without an id too; equal rows share their fate; a score of
    exactly 0.5 stays. Without labels all rows stay. An empty table stays empty. All columns are kept, whatever their names; texts are read whole.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.train(docs, labels.where(~quality.held_out(F.col("doc_id")))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest doc_id: SimHash candidates, 5-word shingles, similarity >= 0.8.

    All texts without words, null ones too, are one class. A row without an id stays only if none of its class has one; of rows of one id the one whose
    text has the smallest hash stays, of rows equal in id and text the least whole row. An empty table stays empty. All columns are kept.
    Very long texts are compared by all their shingles.
    """
    small_batches(spark)
    return simhash.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; equal rows share their fate, two texts of one id or rows without an id don't; an item of fewer than
    ten words is one window; items without words are looked for nowhere. An empty table stays empty. All columns are kept.
    Very long texts are searched whole.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is masked; n_chars follows.

    Every row stays. Null texts stay null with their n_chars; where spans overlap the first one's kind stands for all. All columns are kept.
    Very long texts are searched and masked whole.
    """
    small_batches(spark)
    return pii.mask(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and the digest of the text that they decode to.

    A row each, repeated rows and rows without an id too; null texts count as empty and have no ids. Other columns are left behind.
    Very long texts are encoded and decoded whole.
    """
    small_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, columns=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_leaks),
    ("personal_data", mask_personal_data),
    ("tokens", tokenize),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
