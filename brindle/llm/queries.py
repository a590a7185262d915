"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, exact_dedup, html_extract, line_dedup, mixing, quality, sharding, simhash, suffix_dedup, url_filter

#: (verdict, host and path) of the explicit URL rules
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select("doc_id", "quality.*")


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(_table(spark, sf_dir, "documents"))
    place = lambda i: F.floor(F.get("positions", F.lit(i)) * 1e9) / F.lit(1e9)
    return mix.select("doc_id", "size", "source_size", "target", "taken", place(0).alias("position"), place(1).alias("second_position"))


@_query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return out.select("doc_id", "bpe.*")


@_query
def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return line_dedup.drop_page_lines(pages, with_html=False).select("page_id", "lines.*")


@_query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extracted(pages).select("page_id", "url", "extracted.*")


@_query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.strip_repeats(docs, with_text=False).select("doc_id", "stripped.*")
