"""Reading and writing files: CSV with and without a byte order mark, folders, manifests, reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import corpus as C
from brindle.plans import oracle as O
from brindle.plans.catalog import query
from brindle.plans.corpus import docs
from brindle.sources.tables import read_csv, read_csv_folder, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder: below the shared checkpoint folder, or a temp folder in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp() if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@query("SELECT p_partkey, p_name, p_brand FROM part")
def sink_csv(spark, sf):
    path = folder(spark, "csv")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_brand").write.csv(path, header=True, quoteAll=True)
    return read_csv(spark, path, "p_partkey bigint, p_name string, p_brand string")


@query("SELECT n_nationkey, n_name FROM nation")
def scan_csv_bom(spark, sf):
    path = folder(spark, "bom")
    rows = table(spark, sf, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("line"))
    head = spark.createDataFrame([("﻿n_nationkey,n_name",)], "line string")
    head.union(rows).coalesce(1).write.text(path)
    return read_csv(spark, path, "n_nationkey int, n_name string")


@query("SELECT n_nationkey, n_name FROM nation")
def scan_tsv(spark, sf):
    path = folder(spark, "tab")
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.csv(path, header=True, sep="\t")
    return read_csv(spark, path, "n_nationkey int, n_name string", sep="\t")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def scan_glob_union(spark, sf):
    path = folder(spark, "tree")
    table(spark, sf, "region").select("r_regionkey", "r_name").write.csv(f"{path}/a", header=True)
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.csv(f"{path}/b/c", header=True)
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.csv(f"{path}/holdout", header=True)
    return read_csv_folder(spark, path, "r_regionkey int, r_name string", exclude=["/holdout/"]).drop("file_name")


@query("SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def sink_report_json(spark, sf):
    path = folder(spark, "report")
    docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n")).coalesce(1).write.json(path)
    return spark.read.schema("lang string, n long").json(path)


@query(O.rooted("SELECT source, sha256(coalesce(text, '')) AS d FROM documents", "source", "source, n, root AS digest"))
def sink_frozen_manifest(spark, sf):
    """A digest of each part, written once: a second write to the same place is refused."""
    path = folder(spark, "manifest")
    parts = C.rooted(docs(spark, sf).select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("d")), "source", "d")
    parts.withColumnRenamed("root", "digest").write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


@query("SELECT doc_id, lang, n_chars FROM documents")
def sink_raw_optin(spark, sf):
    """The log of texts without the text: that column is only kept where it is asked for."""
    return logged(docs(spark, sf))


def logged(df: DataFrame, keep_text: bool = False) -> DataFrame:
    return df.select("doc_id", "lang", "n_chars", *(["text"] if keep_text else []))
