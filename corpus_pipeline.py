"""Corpus pipeline: quality rules, exact dedup, near-dedup, source mixing, encoding.

``run`` applies the stages of ``STAGES`` to the documents. Each result is written as Parquet and read again as
the next stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, exact_dedup, mixing, near_copies, quality
from brindle.llm.scratch import Owner, free_name, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"
#: The tables that stages store on the way; each stage first deletes those of the stages before it.
STORED = Owner()


def _stage(f: Stage) -> Stage:
    """A stage whose ``docs`` are a table that was written: then nothing of the stage before is still needed."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with STORED.step(docs):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or repeat themselves too much go: null, empty and short texts among them.

    Texts of any length are read whole; repeated rows stay or go together; other columns are carried along; an empty
    table stays empty.
    """
    return quality.keep_good(docs)


@_stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays, a null doc_id only where there is no other; a null text equals an empty one.

    Texts of any length are compared whole; of repeated rows one stays; other columns are carried along; an empty
    table stays empty.
    """
    return exact_dedup.drop_exact(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with four fifths of their five-word shingles in common the smallest doc_id stays.

    Found by SimHash and covering masks, completed by the shingles themselves and checked exactly. Null and empty
    texts are alike; a null doc_id only stays where there is no other; texts of any length are read whole; of repeated
    rows one stays; other columns are carried along; an empty table stays empty.
    """
    return near_copies.drop_similar(docs)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document that the mix takes words from, in training order.

    Null and empty texts have no words and are not taken; a null source is a source of its own; texts of any length
    count whole; repeated rows are taken one by one; other columns are carried along; an empty table stays empty.
    """
    return mixing.mixed(docs)


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, with digests of the ids and of the decoded text.

    A null or empty text has no ids; texts of any length are encoded whole; repeated rows get the same ids; of the
    other columns doc_id and source are kept; an empty table gives an empty table.
    """
    name = free_name(docs, "bpe")
    out = bpe.encoded(docs.select("doc_id", "source", "text"), public_tokenizers.path(TOKENIZER), name=name)
    return out.select("doc_id", "source", F.col(f"{name}.*"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", source_mixing),
    ("bpe_encoding", encoding),
]
#: Components of near copies and BPE ids are beyond SQL: tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is stored, and what it stored on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        with STORED.step():
            docs = stored(docs, name)
    return STAGES[-1][1](spark, docs, sf_dir)
