"""Sharding over fixed virtual slots.

Records are hashed into thousands of slots, once and for all. Which shard a slot belongs to is in a small
versioned table; rebalancing edits that table and moves whole slots, never single records. Equal records are told
apart by a number, so that copies by the million are spread over the slots like any others.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.scratch import attached, folder, stored

SLOTS = 4096
#: Parts in which the copies of one record are numbered.
PARTS = 256


@dataclass
class SlotMap:
    """Slot to shard, with the edits of each version; its size is the number of slots, whatever the data."""

    shard_of: list[int]
    shards: int
    version: int = 1
    edits: list[tuple[int, int, int, int]] = field(default_factory=list)  # version, slot, from, to

    @classmethod
    def start(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls([slot % shards for slot in range(slots)], shards)

    def _edited(self, shard_of: list[int], shards: int) -> SlotMap:
        edits = [(self.version + 1, s, a, b) for s, (a, b) in enumerate(zip(self.shard_of, shard_of, strict=True)) if a != b]
        return SlotMap(shard_of, shards, self.version + 1, self.edits + edits)

    def rebalanced(self, weight: list[int]) -> SlotMap:
        """The next version: slots move from the fullest shard to the emptiest while that narrows the gap between them."""
        shard_of, load = list(self.shard_of), [0] * self.shards
        owned: list[set[int]] = [set() for _ in range(self.shards)]
        for slot, shard in enumerate(shard_of):
            load[shard] += weight[slot]
            owned[shard].add(slot)
        while True:
            most, least = max(range(self.shards), key=lambda s: (load[s], -s)), min(range(self.shards), key=lambda s: (load[s], s))
            gap = load[most] - load[least]
            fits = [s for s in owned[most] if 0 < weight[s] < gap]
            if not fits:
                return self._edited(shard_of, self.shards)
            slot = min(fits, key=lambda s: (abs(2 * weight[s] - gap), s))
            owned[most].remove(slot)
            owned[least].add(slot)
            shard_of[slot] = least
            load[most] -= weight[slot]
            load[least] += weight[slot]

    def grown(self, weight: list[int]) -> SlotMap:
        """The next version with one more shard, which takes slots from the fullest ones; no other slot moves."""
        shard_of, new, load = list(self.shard_of), self.shards, [0] * self.shards
        owned: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(shard_of):
            load[shard] += weight[slot]
            owned[shard].append(slot)
        for slots in owned:
            slots.sort(key=lambda s: (weight[s], s))
        fair, got = sum(load) / (self.shards + 1), 0
        while got < fair:
            most = max(range(self.shards), key=lambda s: (load[s], -s))
            if not owned[most] or got + weight[owned[most][-1]] > fair * 1.01 + 1:
                break
            slot = owned[most].pop()
            shard_of[slot] = new
            load[most] -= weight[slot]
            got += weight[slot]
        return self._edited(shard_of, self.shards + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.version, slot, shard, self.shards) for slot, shard in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "version int, slot int, shard int, shards int").coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of a saved map, the newest by default."""
        table = spark.read.parquet(path)
        version = version or table.agg(F.max("version")).first()[0]
        rows = sorted((r.slot, r.shard, r.shards) for r in table.filter(F.col("version") == version).collect())  # one row a slot
        return cls([shard for _, shard, _ in rows], rows[0][2], version)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def edited(spark: SparkSession, path: str, weight: list[int], shards: int) -> SlotMap:
    """The newest map at ``path``, grown to ``shards`` and rebalanced for ``weight``; every new version is saved.

    Where there is none, the first version deals the slots in turn. A map that needs no edit gets no new version.
    """
    if _exists(spark, path):
        now = SlotMap.load(spark, path)
        if len(now.shard_of) != len(weight) or now.shards > shards:
            raise ValueError(f"the map at {path} has {len(now.shard_of)} slots and {now.shards} shards")
    else:
        now = SlotMap.start(shards, len(weight))
        now.save(spark, path)
    while now.shards < shards:
        now = now.grown(weight)
        now.save(spark, path)
    after = now.rebalanced(weight)
    if after.shard_of == now.shard_of:
        return now
    after.save(spark, path)
    return after


def _copies(rows: DataFrame) -> DataFrame:
    """(row, copy) of the rows whose ``key`` others have too, numbered from 0 for each key without a gap.

    A key's rows are numbered in parts, so no window holds more than one in PARTS of them.
    """
    many = stored(rows.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"), "repeated-rows")
    found = attached(rows.select("row", "key"), many, ["key"], "rows")
    found = stored(found.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int")), "copies")
    parts = found.groupBy("key", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    found = attached(found, stored(parts, "copy-parts"), ["key", "part"], "rows")
    nth = F.row_number().over(Window.partitionBy("key", "part").orderBy("row"))
    return found.select("row", (F.col("before") + nth - 1).alias("copy"))


def slotted(df: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy, virtual_slot of each row of ``df``, stored; copy numbers rows that agree in the rest."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"))
    rows = stored(rows.withColumn("key", F.xxhash64("doc_id", "text_crc32", "size")), "records")
    copies = stored(_copies(rows), "copy-numbers")
    rows = rows.join(copies, "row", "left").withColumn("copy", F.coalesce("copy", F.lit(0)).cast("long"))
    slot = F.pmod(F.xxhash64("key", "copy"), F.lit(slots)).cast("int")
    return stored(rows.select("doc_id", "size", "text_crc32", "copy", slot.alias("virtual_slot")), "slotted")


def shard(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of each row of ``df``.

    The law is ``bytes``: the map is rebalanced until the shards' sizes are near equal, as far as whole slots
    allow. ``slot`` counts the rows of a shard from 0 without a gap. The map's versions are in the table at
    ``path``: if there are some, the newest is edited, and only slots that an edit names move.

    A null text has size 1, a null doc_id is a value like any other, and a text of any length is one record. Rows
    that agree in doc_id, text and size are numbered and spread by that number. Other columns are not looked at, so
    their names can't clash. An empty table gives an empty table.
    """
    spark = df.sparkSession
    rows = slotted(df, doc_id, text, slots)
    per_slot = {r.virtual_slot: (r.bytes, r.n) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # one row a slot
    path = path or f"{folder(spark)}/slot-map-{uuid.uuid4().hex[:12]}"
    now = edited(spark, path, [per_slot.get(s, (0, 0))[0] for s in range(slots)], shards)
    filled, where = [0] * now.shards, []
    for slot, home in enumerate(now.shard_of):
        where.append((slot, home, filled[home]))
        filled[home] += per_slot.get(slot, (0, 0))[1]
    homes = spark.createDataFrame(where, "virtual_slot int, shard int, before long")
    inside = Window.partitionBy("virtual_slot").orderBy(F.xxhash64("doc_id", "copy"), "doc_id", "text_crc32", "size", "copy")
    rows = rows.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(homes), "virtual_slot")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(now.version).alias("map_version"),
    )
