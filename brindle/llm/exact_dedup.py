"""Exact dedup by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of a fixed size, in one pass that also takes its digest. The different blocks
are sorted, and their places in that order are their integer names; then adjacent names are paired and the pairs are
named the same way, until every text is down to one name. Two texts have the same name at the same level exactly if
they are equal: blocks are told apart by their bytes, and no hash decides, so none can collide.

Copies are put together in each task before blocks travel, so a block that a third of all texts hold arrives once
from each task. Names go back to the rows by the block's hash where only one block has that hash, and by the block's
bytes elsewhere; names with a large share of all rows go by broadcast (``scratch.attached``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.scratch import attached, discard, gathered, numbered, stored

BLOCK = 2048
#: Stands for the missing right half of a pair; no name is so small.
_NONE = -(1 << 62)


def normalised(text: Column) -> Column:
    """Null as empty; every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _sorted_names(keys: DataFrame, by: list[str]) -> DataFrame:
    """``keys`` with an integer ``name`` each: its place in the sorted partitions."""
    return keys.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _named_blocks(blocks: DataFrame, count: int) -> DataFrame:
    """(row, i, n, doc_id, sha, name) of ``count`` stored (row, i, n, doc_id, sha, h, block); h is any hash of block."""
    distinct = blocks.groupBy("h", "block").agg(F.count("*").alias("rows"))
    names = stored(gathered(_sorted_names(distinct, ["h", "block"]).select("h", "name", "rows"), count), "block-names")
    hashes = names.groupBy("h").agg(F.count("*").alias("blocks"), F.min("name").alias("name"), F.sum("rows").alias("rows"))
    hashes = stored(gathered(hashes, count), "hashes")
    narrow = blocks.drop("block")
    sole = attached(narrow, hashes, ["h"], "rows")
    if hashes.filter("blocks > 1").isEmpty():
        return sole.drop("h", "blocks")
    shared = stored(blocks.join(hashes.filter("blocks > 1").select("h"), "h", "left_semi"), "shared-hashes")
    names = stored(_sorted_names(shared.groupBy("h", "block").agg(F.count("*").alias("rows")), ["h", "block"]).withColumn("name", -1 - F.col("name")), "shared-names")
    return sole.filter("blocks = 1").drop("h", "blocks").unionByName(attached(shared, names, ["h", "block"], "rows").drop("h", "block"))


def _named_pairs(pairs: DataFrame, count: int) -> DataFrame:
    """(row, i, n, doc_id, sha, name) of ``count`` stored (row, i, n, doc_id, sha, left, right)."""
    distinct = pairs.groupBy("left", "right").agg(F.count("*").alias("rows"))
    names = stored(gathered(_sorted_names(distinct, ["left", "right"]), count), "pair-names")
    return attached(pairs, names, ["left", "right"], "rows").drop("left", "right")


def identities(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, number: str | None = None, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(row, doc_id, sha, level, name) for each row of ``df``; ``row`` is the column ``number``, or made up."""
    row = F.col(number) if number else F.monotonically_increasing_id()
    rows = df.select(row.alias("row"), F.col(doc_id).alias("doc_id"), normalised(F.col(text)).cast("binary").alias("norm"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / block)).cast("int")
    rows = rows.select("row", "doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), n.alias("n"), "norm")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    first = F.col("i") == 0
    part = F.substring("norm", F.col("i") * block + 1, F.lit(block))
    rows = rows.select("row", "i", "n", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"), part.alias("block"))
    blocks = stored(rows.withColumn("h", hashed("block")), "blocks")
    total = count = blocks.count()
    level = stored(gathered(_named_blocks(blocks, count), count), "level-0")
    discard(blocks)
    most = level.agg(F.max("n")).first()[0] or 1
    done, depth = [], 0
    while True:
        done.append(level.filter("n = 1").select("row", "doc_id", "sha", F.lit(depth).alias("level"), "name"))
        if most == 1:
            break
        most, depth = (most + 1) // 2, depth + 1
        even = F.col("i") % 2 == 0
        pairs = level.filter("n > 1").groupBy("row", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.ceil(F.max("n") / 2).cast("int").alias("n"),
            F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(_NONE)).alias("right"),
        )
        pairs = stored(gathered(pairs, count), "pairs")
        count = pairs.count()
        level = stored(gathered(_named_pairs(pairs, count), count), f"level-{depth}")
    return stored(gathered(reduce(DataFrame.unionByName, done), total), "identities")


def _judged(df: DataFrame, doc_id: str, text: str, block: int, number: str | None = None) -> DataFrame:
    ids = identities(df, doc_id, text, block, number)
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head")
    groups = ids.groupBy("level", "name").agg(F.count("*").alias("group_size"), head)
    groups = groups.select("level", "name", "group_size", F.col("head.doc_id").alias("keep_id"), F.col("head.row").alias("first"))
    groups = gathered(groups.withColumn("rows", F.col("group_size")), ids.count())
    ids = attached(ids, stored(groups, "groups"), ["level", "name"], "rows")
    return ids.select("row", "doc_id", "keep_id", "group_size", (F.col("first") == F.col("row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``df``, dropped ones too.

    Texts are equal when identical after each run of ASCII white space is one space; null counts as empty. Of
    equal texts the row with the smallest doc_id stays (a null doc_id counts as the largest); if that doc_id is
    repeated, one of its rows stays. A text of any length is cut whole. Other columns are not looked at, so their
    names can't clash. An empty table gives an empty table.
    """
    return _judged(df, doc_id, text, block).drop("row")


def drop_exact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` that stay, with its columns; which do is as in ``exact_duplicates``.

    Rows are numbered in a stored copy of ``df``, so nothing depends on how it lists them. Null, empty, very long
    and repeated texts are treated as there; columns of any name are carried along; an empty table stays empty.
    """
    rows, at = numbered(df)
    found = _judged(rows, doc_id, text, block, at)
    gone = found.filter(~F.col("kept")).select(F.col("row").alias(at))
    gone = stored(gathered(gone, rows.count()), "gone")
    return rows.join(gone, at, "left_anti").drop(at)
