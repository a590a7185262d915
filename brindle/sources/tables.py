"""Reading tables: explicit schemas, aliased columns, recursive CSV folders."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed names under which tables carry the text and the label.
TEXT_ALIASES = ("text", "utterance", "query", "sentence", "phrase", "input")
LABEL_ALIASES = ("intent", "label", "expected", "expected_intent", "category", "class")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; zoneless timestamps become instants in the session zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def aliased(df: DataFrame, text: Sequence[str] = TEXT_ALIASES, label: Sequence[str] = LABEL_ALIASES) -> DataFrame:
    """``df`` with the first text alias as ``text`` and the first label alias as ``intent``; case is ignored."""
    there = {c.lower(): c for c in df.columns}

    def pick(names: Sequence[str], what: str) -> str:
        found = next((there[n] for n in names if n in there), None)
        if found is None:
            raise ValueError(f"no {what} column among {df.columns}")
        return found

    a, b = pick(text, "text"), pick(label, "label")
    rest = [c for c in df.columns if c not in (a, b)]
    return df.select(F.col(a).alias("text"), F.col(b).alias("intent"), *rest)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str | None = None) -> DataFrame:
    """CSV or TSV (by suffix) with a header and an explicit schema; a byte order mark is dropped."""
    sep = sep or ("\t" if path.endswith(".tsv") else ",")
    return spark.read.csv(path, schema=schema, header=True, sep=sep, encoding="UTF-8", enforceSchema=True)


def read_csv_folder(spark: SparkSession, path: str, schema: str, exclude: Iterable[str] = ()) -> DataFrame:
    """All CSV files below ``path`` whose path contains none of ``exclude``, with a ``file_name`` column."""
    df = spark.read.csv(path, schema=schema, header=True, recursiveFileLookup=True, pathGlobFilter="*.csv")
    df = df.withColumn("file_name", F.col("_metadata.file_name")).withColumn("__path", F.col("_metadata.file_path"))
    for word in exclude:
        df = df.filter(~F.col("__path").contains(word))
    return df.drop("__path")


def inline(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A small fixed table."""
    return spark.createDataFrame(list(rows), schema)


def values(columns: str, rows: Sequence[tuple]) -> str:
    """The same table as SQL."""

    def literal(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(literal, v)) + "]"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"
