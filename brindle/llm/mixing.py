"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target of words and a schedule: how its share moves over training time 0..1, as a
piecewise-linear curve. The integral of the curve, scaled to the target, is the source's cumulative demand. A
source's documents stand in a fixed pseudo-random order and are read round and round; the document that holds
the y-th word of the demand is trained at the time at which the cumulative demand reaches y. Sorting by that
time, over ranges, gives the training order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.scratch import free_name, gathered, numbered, stored

WEIGHTS = (5, 2, 1)
#: For each weight, the knots (time, level): heavy sources fade out, light ones come in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Hex digits of the order's hash that name a bucket: a source's prefix sums run over its 16^DIGITS buckets first.
DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def inverse(schedule: Sequence[tuple[float, float]], y: Column) -> Column:
    """The time at which the integral of ``schedule``, as a share of the whole, reaches ``y``."""
    parts, total = [], 0.0
    for (t0, m0), (t1, m1) in zip(schedule, schedule[1:], strict=False):
        parts.append((total, t0, m0, (m1 - m0) / (t1 - t0)))
        total += (t1 - t0) * (m0 + m1) / 2
    out = None
    for before, t0, m0, slope in parts:
        rest = y * F.lit(total) - F.lit(before)
        # the root of slope / 2 * u^2 + m0 * u = rest, in a form that also holds for slope 0
        at = F.lit(t0) + F.lit(2.0) * rest / (F.lit(m0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(m0 * m0) + F.lit(2.0 * slope) * rest)))
        out = at if out is None else F.when(y * F.lit(total) >= F.lit(before), at).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source_key, source, source_size) with class, target: shares by weight, filled up to ``cap`` times the size.

    One row for each source. Sources take the weights in turn, by code point, null last.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sizes.withColumn("class", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    df = df.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1).cast("long")).withColumn("most", F.col("source_size") * cap)
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    full, used = F.coalesce(F.sum("most").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    df = df.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - full) / (F.sum("weight").over(whole) - used))
    # the first source, from the one that fills up first, that stays below its cap sets the level for all
    level = F.min_by(F.when(F.col("level") < F.col("most") / F.col("weight"), F.col("level")), F.when(F.col("level") < F.col("most") / F.col("weight"), F.col("most") / F.col("weight"))).over(whole)
    target = F.when(level.isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), level * F.col("weight")))
    return df.select("source_key", "source_size", "class", target.alias("target"))


def mixture(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: float = 1.5, cap: int = 2, number: str | None = None) -> DataFrame:
    """row, doc_id, size, source_size, target, taken, positions for each row of ``df``, sorted by first position.

    ``size`` counts words (null: 0), of the whole text. ``taken`` is how many of them the mix takes, repeats counted:
    at most ``cap`` times the size, and in each source the target in all, to the word. ``positions`` has a training
    time for each pass that takes some, in order; texts without words and rows beyond the target have none and come
    last. The order is a hash of doc_id, so reruns agree; repeated rows take consecutive places. A null source is a
    source of its own. ``row`` is the column ``number``, or made up. Other columns are not looked at, so their names
    can't clash. An empty table gives an empty table. Targets go through one task, with one row for each source.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = df.select((F.col(number) if number else F.monotonically_increasing_id()).alias("row"), F.col(doc_id).alias("doc_id"), key.alias("source_key"), words(F.col(text)).alias("size"))
    rows = rows.withColumn("place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = stored(rows.withColumn("bucket", F.substring("place", 1, DIGITS)), "sizes")
    count = rows.count()
    buckets = stored(gathered(rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size")), count), "buckets")
    per_source = buckets.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size"))
    per_source = per_source.withColumn("source", F.when(F.col("source_key") != "", F.substring("source_key", 2, 1 << 30)))
    plan = stored(targets(per_source, weights, share, cap), "targets")
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start")).join(plan, "source_key")
    rows = rows.join(stored(gathered(buckets, count), "bucket-starts"), ["source_key", "bucket"])
    inside = Window.partitionBy("source_key", "bucket").orderBy("place", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = rows.withColumns({"start": start, "limit": F.floor(F.col("target") + 0.5).cast("long")})
    starts = [F.col("start") + k * F.col("source_size") for k in range(cap)]
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("limit") - s)).cast("long") for s in starts]

    def time(s: Column) -> Column:
        y, out = s / F.col("target"), F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            out = F.when(F.col("class") == k, inverse(schedule, y)).otherwise(out)
        return out

    rows = rows.withColumn("taken", sum(takes[1:], takes[0]))
    rows = rows.withColumn("positions", F.filter(F.array(*(F.when(t > 0, time(s)) for s, t in zip(starts, takes, strict=True))), F.isnotnull))
    rows = rows.withColumn("position", F.get("positions", F.lit(0)))
    rows = rows.repartitionByRange(F.asc_nulls_last("position"), F.col("place")).sortWithinPartitions(F.asc_nulls_last("position"), "place")
    return rows.select("row", "doc_id", "size", "source_size", "target", "taken", "positions")


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` in training order, one for each pass; which and where is as in ``mixture``.

    Rows are numbered in a stored copy of ``df``, so nothing depends on how it lists them. Rows without words (null,
    empty or blank texts) and rows beyond the target are not taken; columns of any name are carried along.
    """
    rows, at = numbered(df)
    spot = free_name(rows, "position")
    plan = mixture(rows, number=at, **options).select(F.col("row").alias(at), F.explode("positions").alias(spot))
    rows = rows.join(stored(gathered(plan, rows.count()), "training-plan"), at)
    return rows.repartitionByRange(spot, at).sortWithinPartitions(spot, at).drop(at, spot)
