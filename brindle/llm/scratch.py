"""Intermediate tables in the folder that the cluster shares.

The folder is the one in ``spark.checkpoint.dir``. Only where it is unset is one chosen here: a temp folder
in local mode, the warehouse otherwise. Tables are written as Parquet, so a lost executor loses none of them.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Bytes of a row group of a stored table: what a task buffers for each file that it writes.
ROW_GROUP = 16 << 20
#: A value that one in HOT_SHARE rows has, or more, is joined by broadcast: HOT_SHARE values at most, whatever the table.
HOT_SHARE = 10_000


def folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local["):
            if not _LOCAL:
                _LOCAL.append(tempfile.mkdtemp(prefix="brindle-"))
            base = _LOCAL[0]
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/brindle-{spark.sparkContext.applicationId}"


#: Deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage, and is computed once however often it is used."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path, partitionBy=partition_by)
    finally:
        spark.conf.set(_CLEANUP, before)
    if _OWNERS:
        _OWNERS[-1].paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of few rows is written by FEW tasks, a larger one by a task for each SHARE rows at least.
FEW, SHARE = 12, 20_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of some ``rows`` rows, in so few partitions that a small table isn't written as hundreds of files."""
    return df.coalesce(max(FEW, rows // SHARE + 1))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete every table that this application stored; call it when no result that reads them is still needed."""
    _delete(spark, folder(spark))


class Owner:
    """Tables that the steps of one job store, so that a step can delete what earlier ones no longer need."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    @contextlib.contextmanager
    def step(self, docs: DataFrame | None = None) -> Iterator[None]:
        """Tables stored inside belong to this owner. With ``docs``, a new step's input, its earlier ones are deleted
        beforehand, but for those that ``docs`` itself reads: whatever else still needs them must have been written."""
        if docs is not None:
            read = _roots(docs)
            gone = [p for p in self.paths if not any(r.endswith(p.split(":", 1)[-1]) for r in read)]
            for path in gone:
                _delete(docs.sparkSession, path)
            self.paths = [p for p in self.paths if p not in gone]
        _OWNERS.append(self)
        try:
            yield
        finally:
            _OWNERS.remove(self)


_OWNERS: list[Owner] = []


def _roots(df: DataFrame) -> list[str]:
    """The folders and files that the plan of ``df`` reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            paths = leaf.relation().location().rootPaths()
            out += [paths.apply(j).toString() for j in range(paths.size())]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them must be stored itself."""
    for df in tables:
        for path in _roots(df):
            _delete(df.sparkSession, path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """A stored copy of ``df`` with a different integer for each row, and that column's name.

    Written once: rows of a table that is read twice may be listed otherwise the second time, since splits depend
    on the executors that are there.
    """
    name = free_name(df, "row_number")
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def attached(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each value of ``keys`` and says how many ``rows`` have it.

    Values with a large share of the rows are joined by broadcast. Both sides must be stored tables; keys not null.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    large = F.col(count) * HOT_SHARE >= total  # counts sum to total, so this holds for HOT_SHARE values at most
    hot = F.broadcast(table.filter(large).drop(count))
    cold = rows.join(F.broadcast(table.filter(large).select(keys)), keys, "left_anti").join(table.filter(~large).drop(count), keys)
    return rows.join(hot, keys).unionByName(cold)
