"""Threshold sweeps: grid times data, with the data compressed to a histogram first.

Confidence and margin are kept as grid steps (floor(conf * 200), floor(margin * 20)), so a histogram has at most
200 * 20 cells for each outcome whatever the number of rows, and the grid is joined to cells, not to rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(scored: DataFrame, *by: str) -> DataFrame:
    """(c, m, ..., n) from scored rows."""
    return scored.groupBy("c", "m", *by).agg(F.count("*").alias("n"))


def grid(spark, **axes: list[int]) -> DataFrame:
    out = None
    for name, steps in axes.items():
        axis = spark.createDataFrame([(s,) for s in steps], f"{name} int")
        out = axis if out is None else out.crossJoin(axis)
    return out


def swept(cells: DataFrame, points: DataFrame, **measures: Column) -> DataFrame:
    """For each grid point the number of rows in cells that fulfil each condition on cell and point."""
    joined = cells.crossJoin(F.broadcast(points))
    counts = [F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name) for name, cond in measures.items()]
    return joined.groupBy(*points.columns).agg(*counts)


def best(df: DataFrame, *order: Column) -> DataFrame:
    """The first row by a full order."""
    return df.orderBy(*order).limit(1)
