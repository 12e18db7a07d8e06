"""A training corpus from ``documents``: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of
``docs``. Nulls, empty texts, repeated rows and empty tables have the results that the
operators' docstrings state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnetic.llm import bpe, exact, language, minhash, mixing
from limnetic.llm.common import free_names, remainder, small_join, table
from limnetic.session import tune, written

# Texts of whose n-grams no language knows this share are rejected, like those without a letter.
LEAST_COVERAGE = 0.3
# The catch-all source at three shares, every other source at one.
MIXTURE = {"src0": 3.0}
VOCABULARY = "word_bpe_49k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts in none of the learned languages.

    A missing or empty text has no letter and goes. If no row has a language to learn
    from, every text is of an unknown language and goes.
    """
    tune(spark)
    filters = language.fit_filters(docs, remainder("doc_id", 4) != 2)
    (into,) = free_names(docs.columns, "_judged")
    judged = language.identify(docs, filters, into=into)
    known = (F.col(into)["language"] != "und") & (F.col(into)["coverage"] >= LEAST_COVERAGE)
    return judged.where(known).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts; of rows alike in key and text, one."""
    tune(spark)
    return exact.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links of 0.8 on five-word shingles connect.

    Rows without a key are linked with nothing and stay; rows of one key are one document.
    """
    tune(spark)
    found = written(minhash.near_duplicates(docs, words=5, least=(80, 100)), "pipeline-near")
    (gone,) = free_names(docs.columns, "_dropped")
    dropped = found.where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return small_join(docs, dropped, F.col("doc_id") == F.col(gone), 16 * dropped.count(), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out rows so that the sources reach the target mixture, in random order."""
    tune(spark)
    copy, order = free_names(docs.columns, "_copy", "_order")
    return mixing.mix_sources(docs, MIXTURE, copy=copy, order=order).select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every row; a document stands as often as it was repeated."""
    tune(spark)
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

# SQL can express neither the language filters nor the merges of the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
