"""Row-wise helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however often they are used further on.

    The optimiser merges projections, which would copy a costly expression into each place that names it; it
    doesn't merge them across a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
