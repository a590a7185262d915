"""Corpus engineering: leakage guards, dedup, conflicts, caps, splits, corruption. DataFrame in, DataFrame out.

Spark rows have no order, so "first" always means lowest in an explicit id column, and random choices are
orders by md5 of the id and a seed: the same on every run, engine and partitioning. Per-label rankings run in
buckets of that order, with prefix sums over the buckets, so no task sorts a label that is most of the data;
``top_per_label`` cuts within hash buckets first, so no task sorts more than its bucket and the survivors.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(seed: int | str, *ids: str) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat_ws("|", *(F.col(i).cast("string") for i in ids), F.lit(str(seed))))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that of the lowest ``order``: a partial aggregate, so a hot key moves one row a task."""
    packed = F.min(F.struct(F.col(order).alias("__order"), F.struct(*df.columns).alias("__row"))).alias("__first")
    return df.groupBy(F.col(key).alias("__key")).agg(packed).select("__first.__row.*")


def leaks(train: DataFrame, held_out: DataFrame, key: str, order: str) -> DataFrame:
    """The first training row for each key that is also held out; empty keys don't count."""
    found = train.filter(F.col(key) != "").join(held_out.select(key).distinct(), key, "left_semi")
    return first_per_key(found, key, order)


def leaking(df: DataFrame, held_out: Column, key: str, order: str) -> DataFrame:
    """(key, order): the same in one pass, for a table whose rows say whether they are held out."""
    mine = F.coalesce(held_out, F.lit(False))
    found = df.filter(F.col(key) != "").groupBy(key).agg(F.min(F.when(~mine, F.col(order))).alias(order), F.bool_or(mine).alias("__held"))
    return found.filter(F.col("__held") & F.col(order).isNotNull()).drop("__held")


def without_leaks(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    return train.join(held_out.select(key).distinct(), key, "left_anti")


def conflicting_keys(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, labels) of keys with more than one label."""
    return df.groupBy(key).agg(F.countDistinct(label).alias("labels")).filter("labels > 1")


def without_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.join(conflicting_keys(df, key, label).select(key), key, "left_anti")


def top_per_label(df: DataFrame, label: str, order: Column, n: int, tie: str, buckets: int = 64) -> DataFrame:
    """The first ``n`` rows of each label; each bucket of a label gives up its own first ``n`` beforehand."""
    bucket = F.pmod(F.xxhash64(tie), F.lit(buckets))
    rows = df.withColumns({"__order": order, "__bucket": bucket})
    within = Window.partitionBy(label, "__bucket").orderBy("__order", tie)
    rows = rows.withColumn("__n", F.row_number().over(within)).filter(F.col("__n") <= n)
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(label).orderBy("__order", tie)))
    return rows.filter(F.col("__n") <= n).drop("__order", "__bucket", "__n")


def oversampled(df: DataFrame, wanted: Column, times: int) -> DataFrame:
    """Rows that fulfil ``wanted`` ``times`` times, numbered by ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(wanted, F.lit(times)).otherwise(F.lit(1)))))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows / (labels * rows of the label)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("__rows"), F.count("*").alias("__labels"))
    return counts.crossJoin(F.broadcast(totals)).select(label, "n", (F.col("__rows") / (F.col("__labels") * F.col("n"))).alias("weight"))


#: Hex digits of the random order that name a bucket: a label is ranked in 16^DIGITS parts.
DIGITS = 3


def ranked(df: DataFrame, label: str, seed: int | str, *ids: str, weight: str | None = None) -> DataFrame:
    """``df`` with rank and size of each row within its label, in a reproducible random order.

    With a ``weight`` column also before and total: its sum over the earlier rows of the label, and over all of them.
    ``df`` is read twice; null is a label too.
    """
    rows = df.withColumn("__order", shuffled(seed, *ids)).withColumn("__bucket", F.substring("__order", 1, DIGITS))
    sums = [F.count("*").alias("__rows"), *([F.sum(weight).alias("__weight")] if weight else [])]
    cells = rows.groupBy(F.col(label).alias("__label"), F.col("__bucket").alias("__cell")).agg(*sums)
    earlier = Window.partitionBy("__label").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__label")
    extra = {"__rows_before": F.coalesce(F.sum("__rows").over(earlier), F.lit(0)), "size": F.sum("__rows").over(whole)}
    if weight:
        extra |= {"__weight_before": F.coalesce(F.sum("__weight").over(earlier), F.lit(0)), "total": F.sum("__weight").over(whole)}
    cells = cells.withColumns(extra)
    rows = rows.join(cells, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__bucket") == F.col("__cell")))
    inside = Window.partitionBy(label, "__bucket").orderBy("__order", *ids)
    rows = rows.withColumn("rank", F.col("__rows_before") + F.row_number().over(inside))
    if weight:
        rows = rows.withColumn("before", F.col("__weight_before") + F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.select(*df.columns, "rank", "size", *(["before", "total"] if weight else []))


def summed(df: DataFrame, order: Sequence[str], value: Column, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each, by ``order``, which must tell rows apart.

    Rows are sorted in ranges, and the ranges' sums added up: one row for each partition goes through one task.
    """
    rows = df.withColumn("__value", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    rows = checkpointed(rows)  # splits of ranges are sampled: a second reading could cut elsewhere
    parts = rows.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(name, F.coalesce(F.sum("__value").over(inside), F.lit(0))).join(starts, "__part")
    return out.withColumn(name, F.col(name) + F.col("__start")).select(*df.columns, name)


def rooted(df: DataFrame, by: str, digest: str, digits: Sequence[int] = (6, 3)) -> DataFrame:
    """(by, n, root): a digest over the sorted digests (hex) of each group, whatever its size.

    Digests with the same first digits are joined by newlines, in order, and hashed; then those hashes by fewer
    digits, and so on up to the root. So no array holds more than a small part of a group.
    """
    level = df.select(F.col(by).alias(by), F.col(digest).alias("__at"), F.col(digest).alias("__d"), F.lit(1).cast("long").alias("__n"))
    for width in (*digits, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__d"))), lambda x: x["__d"]), "\n")
        level = level.groupBy(by, F.substring("__at", 1, width).alias("__at")).agg(F.sha2(joined, 256).alias("__d"), F.sum("__n").alias("__n"))
    return level.select(by, F.col("__n").alias("n"), F.col("__d").alias("root"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, group): smallest node reachable over undirected ``edges`` (a, b); stops when no label moves.

    Each round takes the smallest label among the neighbours and then that label's own label, so the rounds needed
    grow with the logarithm of the longest chain for most graphs; labels only ever fall, so it ends.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b")).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("group")))
    total, before = None, ()
    while total != before:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("group").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("group").alias("far"))
        labels = checkpointed(near.join(jump, "near").select(F.col("a").alias("node"), F.least("near", "far").alias("group")))
        before, total = total, labels.agg(F.sum(F.xxhash64("node", "group").cast("decimal(38,0)"))).first()[0]
    return labels


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder."""
    _checkpoint_folder(df)
    return df.checkpoint()


def _checkpoint_folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        import tempfile

        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return context.getCheckpointDir()


#: Deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The same as Parquet, which is far smaller; the shuffle files behind it are deleted."""
    spark = df.sparkSession
    path = f"{_checkpoint_folder(df)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", 16 << 20).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
