"""Evaluation metrics as aggregates: each is a partial aggregate and a projection over few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.corpus import summed


def per_label(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(label, tp, fp, fn) over the union of gold and predicted labels."""
    sides = F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"))))
    hit = (F.col(gold) == F.col(pred)).cast("int").alias("hit")
    rows = df.select(hit, sides.alias("s")).select("hit", "s.*")
    return rows.groupBy("label").agg(F.sum(F.col("g") * F.col("hit")).alias("tp"), F.sum(F.col("p") * (1 - F.col("hit"))).alias("fp"), F.sum(F.col("g") * (1 - F.col("hit"))).alias("fn"))


def f1() -> Column:
    return F.coalesce(2 * F.col("tp") / F.expr("nullif(2 * tp + fp + fn, 0)"), F.lit(0.0))


def calibration(df: DataFrame, bins: int, bin_of: Column, conf: str = "conf", correct: str = "correct") -> DataFrame:
    """(bin, n, accuracy, confidence) for each bin from 0 that has rows."""
    right = F.col(correct).cast("int")
    rows = df.withColumn("bin", bin_of.cast("int")).filter(F.col("bin").between(0, bins - 1))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(conf).alias("confidence"))


def ece(df: DataFrame, bins: int, bin_of: Column, **columns: str) -> DataFrame:
    """Expected calibration error; rows whose bin is null or out of range count in the total only."""
    total = df.agg(F.count("*").alias("total"))
    gaps = calibration(df, bins, bin_of, **columns).crossJoin(F.broadcast(total))
    return gaps.agg(F.coalesce(F.sum(F.col("n") / F.col("total") * F.abs(F.col("accuracy") - F.col("confidence"))), F.lit(0.0)).alias("ece"))


def edge_bin(conf: Column, bins: int, first_closed: bool = False, last: float = 1.0) -> Column:
    """Bin i for edges i / bins < conf <= (i + 1) / bins, by comparison with the edges themselves."""
    below = sum((conf > F.lit(i / bins)).cast("int") for i in range(bins)) - 1
    below = F.when(conf <= last, below)
    return F.greatest(below, F.lit(0)) if first_closed else F.when(below >= 0, below)


def average_rank(df: DataFrame, score: str) -> DataFrame:
    """``df`` with the rank of each row by ``score``, ties averaged; ranks come from counts for each score, summed in ranges."""
    counts = df.groupBy(F.col(score).alias("__s")).agg(F.count("*").alias("__n"))
    ranks = summed(counts, ["__s"], F.col("__n"), "__before").select("__s", (F.col("__before") + (F.col("__n") + 1) / 2).alias("rank"))
    return df.join(ranks, F.col(score) == F.col("__s")).drop("__s")


def wilson_halfwidth(p: Column, n: Column, z: float = 1.96) -> Column:
    return z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)


def share(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def unpivoted(df: DataFrame, names: Sequence[str], key: str = "metric", value: str = "value") -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias(key), F.col(n).cast("double").alias(value)) for n in names)))
    return df.select(cells.alias("x")).select("x.*")
