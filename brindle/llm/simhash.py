"""SimHash near-dedup with covering locality-sensitive hashing.

For radius r each bit of the fingerprint is given a non-zero vector of r + 1 bits. Every non-zero vector v of
that length makes one table, whose mask holds the bits whose vectors have an odd inner product with v. The
vectors of any r differing bits span r dimensions at most, so some v is orthogonal to all of them: in that table
the two fingerprints agree on the whole mask. So every pair within the radius meets, with no chance involved.

Inside a bucket no pairs are listed: a search from one fingerprint takes what it reaches out of the rest, and
one link for each fingerprint found is passed on to connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.arrow_text import tidy
from brindle.llm.components import components
from brindle.llm.scratch import attached, gathered, numbered, stored

SHINGLE, RADIUS, BITS, SEED = 4, 4, 64, 42
#: Larger buckets are split by a second covering code over the bits that the first leaves out.
SPLIT = 4096
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = max(1, len(words) - width + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, last, _BLOCK):
        hi = min(last, lo + _BLOCK)
        stops = ends[np.minimum(np.arange(lo, hi) + width - 1, len(words) - 1)]
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), stops.tolist(), strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", number: str | None = None, width: int = SHINGLE) -> DataFrame:
    """(row, doc_id, fp) of each row of ``df``, stored; fp is the fingerprint as a signed long, row the column ``number`` or made up."""
    row = F.col(number) if number else F.monotonically_increasing_id()
    rows = df.select(row.alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.select("row", "doc_id").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            found = [fingerprint(t, width) for lo in range(0, len(texts), 256) for t in texts.slice(lo, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))], names=["row", "doc_id", "fp"])

    return stored(rows.mapInArrow(tidy(run), kind), "fingerprints")


def masks(radius: int = RADIUS, bits: list[int] | None = None) -> list[int]:
    """The masks of all tables over the given bits."""
    bits = list(range(BITS)) if bits is None else bits
    vectors = (1 << (radius + 1)) - 1
    given = {bit: i % vectors + 1 for i, bit in enumerate(bits)}
    return [sum(1 << bit for bit, x in given.items() if (x & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Runs of two or more equal keys in a sorted array."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    long = np.flatnonzero(np.diff(edge) > 1)
    return list(zip(edge[long].tolist(), edge[long + 1].tolist(), strict=True))


def _reach(fps: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """(fingerprint, the others that chains of links lead to from it)."""
    out, rest = [], fps
    while len(rest) > 1:
        root, found, front, rest = rest[0], [], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                found.append(rest[near])
                front.extend(rest[near])
                rest = rest[~near]
        if found:
            out.append((root, np.concatenate(found)))
    return out


def linked(fps: np.ndarray, radius: int, mask: int) -> list[tuple[int, np.ndarray]]:
    """Links that connect all pairs within the radius among different fingerprints that agree on ``mask``."""
    if len(fps) <= SPLIT:
        return _reach(fps, radius)
    out = []
    for inner in masks(radius, [b for b in range(BITS) if not mask >> b & 1]):
        order = np.argsort(fps & np.uint64(inner))
        keys = fps[order] & np.uint64(inner)
        for lo, hi in _runs(keys):
            out += _reach(fps[order[lo:hi]], radius)
    return out


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): enough links between different fingerprints (column fp) to connect all that are within the radius."""
    table = masks(radius)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in table]
    keyed = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed))))
    rows = distinct.select("fp", keyed.alias("x")).select("x.t", "x.k", "fp")
    rows = rows.repartition("t", "k").sortWithinPartitions("t", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(t: np.ndarray, k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            pair = np.empty(len(t), [("t", t.dtype), ("k", k.dtype)])
            pair["t"], pair["k"] = t, k
            for lo, hi in _runs(pair):
                for root, found in linked(fp[lo:hi].view(np.uint64), radius, table[t[lo]]):
                    a.append(np.full(len(found), root, np.uint64))
                    b.append(found)
            join = lambda x: pa.array((np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64))
            return pa.RecordBatch.from_arrays([join(a), join(b)], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            tail = len(t) - int(np.argmax((t[::-1] != t[-1]) | (k[::-1] != k[-1]))) if t[0] != t[-1] or k[0] != k[-1] else 0
            if held and tail == 0 and held[-1][0][-1] == t[0] and held[-1][1][-1] == k[0]:
                held.append([t, k, fp])  # the bucket goes on
                continue
            yield search(*(np.concatenate([*(h[i] for h in held), c[:tail]]) for i, c in enumerate((t, k, fp))))
            held = [[t[tail:], k[tail:], fp[tail:]]]
        if held:
            yield search(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    return rows.mapInArrow(tidy(run), "a long, b long")


def _classes(df: DataFrame, doc_id: str, text: str, radius: int, width: int, number: str | None = None) -> DataFrame:
    """(row, doc_id, fp, root, component_id); root is the smallest fingerprint of the component."""
    rows = fingerprints(df, doc_id, text, number, width)
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "distinct")
    roots = stored(components(links(distinct.select("fp"), radius)), "roots")
    linked_fps = roots.select(F.col("node").alias("fp"), "root").union(roots.select("root", "root").distinct())
    members = stored(distinct.join(linked_fps, "fp"), "members")
    count = members.count()
    firsts = stored(gathered(members.groupBy("root").agg(F.min("first").alias("component_id")), count), "firsts")
    lookup = stored(gathered(members.select("fp", "root", "rows").join(firsts, "root"), count), "lookup")
    alone = distinct.join(lookup, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"), "rows")
    return attached(rows, stored(lookup.select("fp", "root", "component_id", "rows").union(alone), "classes"), ["fp"], "rows")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``df``.

    Texts are lower-cased in A-Z, cut into words at ASCII white space and into shingles of ``width`` words; texts of
    fewer words are one shingle, null and empty texts have fingerprint zero and are linked like any other. A text of
    any length is read whole. Fingerprints that differ in ``radius`` bits at most are linked, and components follow
    chains of links. ``component_id`` is the smallest doc_id of the component; a null doc_id only counts where there
    is no other. Repeated rows give repeated results. Other columns are not looked at, so their names can't clash.
    An empty table gives an empty table.
    """
    found = _classes(df, doc_id, text, radius, width)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """One row of ``df`` for each component of ``near_duplicates``: that of the smallest doc_id.

    Rows are numbered in a stored copy of ``df``, so nothing depends on how it lists them. Null, empty, very long and
    repeated texts are treated as there; columns of any name are carried along; an empty table stays empty.
    """
    rows, at = numbered(df)
    found = _classes(rows, doc_id, text, radius, width, at).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stored(found.groupBy("root").agg(F.min("row").alias(at)).select(at), "stay")
    return rows.join(stay, at, "left_semi").drop(at)
