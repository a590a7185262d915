"""Connected components of a distributed edge list, by alternating large-star and small-star rounds.

Each round points every node at the smallest neighbour it has; the number of rounds grows with the logarithm of
the longest path. Edges stay in tables, one row for each; only two sums reach the driver, to see when to stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.scratch import gathered, stored


def _smallest(pairs: DataFrame, key: str, value: str, rows: int) -> DataFrame:
    return stored(gathered(pairs.groupBy(key).agg(F.min(value).alias("m")), rows), "smallest")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b) that isn't the smallest of its component; root is that.

    Loops and repeated edges do no harm; no edges give no rows. With ``nodes``, how many there may be, the edges too are
    written in few files.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct()
    edges = stored(edges if nodes is None else gathered(edges, nodes), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("big").alias("u"), F.col("small").alias("v")).union(edges.select("small", "big"))
        near = _smallest(both, "u", "v", 2 * state[0]).select("u", F.least("u", "m").alias("m"))
        large = both.join(near, "u").filter("v > u").select(F.col("v").alias("big"), F.col("m").alias("small"))
        large = stored(gathered(large.distinct(), state[0]), "large-star")
        down = large.join(_smallest(large, "big", "small", state[0]), "big")
        down = down.filter("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small")).union(down.select("big", F.col("m").alias("small")))
        edges = stored(gathered(down.distinct(), state[0]), "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    return gathered(edges.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("root")), state[0])
