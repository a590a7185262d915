"""Near copies by SimHash and, beyond its radius, by MinHash bands; checked exactly by the similarity of word shingles.

Fingerprints of five-word shingles that differ in a few bits are found by covering locality-sensitive hashing, as in
``simhash``. A similarity of 4/5 is some 10 of a fingerprint's 64 bits and up to 20, and a covering code for so many
has millions of tables; so sets that share one of BANDS bands of ROWS smallest hashes meet as well. Two sets of
similarity s share none with a probability of (1 - s^ROWS)^BANDS: 3 in a million at 4/5, less above.

In a bucket pairs are ruled out by a bound: sets that differ in d shingles differ by d at most in how many fall into
each of 256 classes. What is left is checked on the sets. First each bucket's sets are held against a few of its own,
which links large groups; then all pairs that are not yet in one component are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.arrow_text import tidy
from brindle.llm.components import components
from brindle.llm.scratch import attached, discard, gathered, numbered, stored
from brindle.llm.simhash import RADIUS, links

#: Words of a shingle, and the least similarity as NUM / DEN.
WIDTH, NUM, DEN, SEED = 5, 4, 5, 42
BANDS, ROWS = 32, 5
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.random.default_rng(12).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
CLASSES = 256
_BLOCK = 1 << 16


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different shingles of the text as sorted XXH64 digests; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    starts, digest = np.r_[0, ends[:-1] + 1], xxhash.xxh64_intdigest
    starts, stops = starts[: len(words) - width + 1], ends[width - 1 :]
    out = [np.array([digest(whole[a:b], SEED) for a, b in zip(starts[lo : lo + _BLOCK].tolist(), stops[lo : lo + _BLOCK].tolist(), strict=True)], np.uint64) for lo in range(0, len(starts), _BLOCK)]
    return np.unique(np.concatenate(out))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band: equal for two sets if the band's smallest hashes are."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for lo in range(0, len(found), 4096):
        h = (found[lo : lo + 4096, None] ^ _SALTS) * _FACTORS
        np.minimum(least, h.min(0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64) * _STEP
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _STEP
        keys ^= keys >> np.uint64(29)
    return keys


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is 1 if set in over half of them."""
    counts = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<u8")[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _batched(run: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return tidy(lambda batches: (run(b.slice(lo, 256)) for b in batches for lo in range(0, b.num_rows, 256)))


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, same, fp, size, hist, keys); same is a digest of the set, fp its fingerprint, hist its shingles by class."""
    kind = rows.select("row", "doc_id", F.lit(b"").alias("same"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("size"), F.lit(b"").alias("hist"), F.array(F.lit(0).cast("long")).alias("keys")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        same, fp, size, hist, keys = [], [], [], [], []
        for t in batch.column(2).to_pylist():
            s = shingles(t, width)
            same.append(hashlib.sha256(s.tobytes()).digest())
            fp.append(fingerprint(s))
            size.append(len(s))
            hist.append(np.minimum(np.bincount((s % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes())
            keys.append(bands(s).view(np.int64))
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), pa.array(np.concatenate(keys)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(hist, pa.binary()), lists], names=kind.names)

    return stored(rows.mapInArrow(_batched(run), kind), "sketches")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first column, for runs of two or more; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(0).to_numpy()
        edge = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)].tolist() if len(k) else [0]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != k[lo]:
                if sum(h.num_rows for h in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if sum(h.num_rows for h in held) > 1:
        yield pa.Table.from_batches(held)


def _meet(members: DataFrame) -> DataFrame:
    """(a, b) with a < b: pairs in a bucket k that may be similar. Without a column label, each bucket's sets are held
    against the first of it, those ruled out against the first of them and so on; with it, all of different labels are."""
    across = "label" in members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            row, size = t["row"].to_numpy(), t["size"].to_numpy().astype(np.int64)
            hist = np.frombuffer(b"".join(t["hist"].to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16)
            label = t["label"].to_numpy() if across else None
            rest, a, b = np.arange(len(row)), [], []
            while len(rest) > 1:
                i, rest = rest[0], rest[1:]
                differ = np.abs(hist[rest] - hist[i]).sum(1, dtype=np.int64)
                may = _may(differ, size[rest] + size[i])
                hit = rest[may & (label[rest] != label[i])] if across else rest[may]
                a.append(np.minimum(row[hit], row[i]))
                b.append(np.maximum(row[hit], row[i]))
                rest = rest if across else rest[~may]
                if sum(map(len, a)) > _BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                    a, b = [], []
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return members.repartition("k").sortWithinPartitions("k", "row").mapInArrow(tidy(run), "a long, b long").distinct()


def _checked(pairs: DataFrame, rows: DataFrame, width: int, count: int) -> DataFrame:
    """The pairs whose sets are similar; ``count`` is how many ``rows`` there are."""
    pairs = stored(gathered(pairs, count), "pairs")
    asked = stored(gathered(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), count), "asked")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["row", "set"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = lambda x: np.frombuffer(x.as_py(), np.uint64)
        good = [similar(read(x), read(y)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        return batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    known = rows.select("row", "text").join(asked, "row", "left_semi").mapInArrow(_batched(sets), "row long, set binary")
    known = stored(gathered(known, asked.count()), "sets")
    both = pairs.join(known.select(F.col("row").alias("a"), F.col("set").alias("x")), "a").join(known.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")
    both = both.select("a", "b", "x", "y").mapInArrow(_batched(run), "a long, b long")
    found = stored(gathered(both, pairs.count()), "similar")
    discard(pairs, asked, known)
    return found


def _by_fingerprint(reps: DataFrame, radius: int, count: int) -> DataFrame:
    """(a, b), a < b: links between those of ``count`` ``reps`` (row, fp, size, hist) whose fingerprints are within ``radius`` and that may be similar."""
    fps = reps.groupBy("fp").agg(F.min("row").alias("root"), F.count("*").alias("rows"))
    fps = stored(gathered(fps, count), "fingerprint-roots")
    same = attached(reps.select("row", "fp"), fps, ["fp"], "rows").filter("row <> root").select(F.col("root").alias("a"), F.col("row").alias("b"))
    one = fps.select(F.col("fp").alias("a"), F.col("root").alias("x"))
    near = links(fps.select("fp"), radius).join(one, "a").join(one.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
    pairs = same.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    side = lambda a, n, h: reps.select(F.col("row").alias(a), F.col("size").alias(n), F.col("hist").alias(h))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [batch.column(i).to_numpy().astype(np.int64) for i in (2, 3)]
        h = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16) for i in (4, 5)]
        return batch.select([0, 1]).filter(pa.array(_may(np.abs(h[0] - h[1]).sum(1, dtype=np.int64), n[0] + n[1])))

    both = pairs.join(side("a", "n", "g"), "a").join(side("b", "m", "h"), "b").select("a", "b", "n", "m", "g", "h")
    return both.mapInArrow(_batched(run), "a long, b long")


def _may(differ: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets may be similar: they differ in ``differ`` shingles at least, and have ``sizes`` in all."""
    return (DEN + NUM) * differ <= (DEN - NUM) * sizes


def drop_similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of ``df`` for each component of similar texts: that of the smallest doc_id.

    Texts are lower-cased in A-Z and cut into words at ASCII white space. Two are linked when their sets of shingles
    of ``width`` words have a Jaccard similarity of 4/5 or more; components follow chains of links. Texts of fewer
    words are one shingle, null and empty ones an empty shingle. A null doc_id only stays where there is no other.
    A text of any length is read whole. Rows are numbered in a stored copy of ``df``, so nothing depends on how it
    lists them; columns of any name are carried along; an empty table stays empty.
    """
    copy, at = numbered(df)
    rows = copy.select(F.col(at).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = _sketches(rows, width)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    count = found.count()
    sets = stored(gathered(found.groupBy("same").agg(F.min("row").alias("rep"), best).drop("same"), count), "different-sets")
    reps = found.join(sets.select(F.col("rep").alias("row")), "row", "left_semi")
    keyed = reps.select(F.explode("keys").alias("k"), "row").repartition("k").sortWithinPartitions("k", "row")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        def runs(k: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            of = np.diff(edge)
            many = np.flatnonzero(of > 1)
            named = [xxhash.xxh64_intdigest(row[lo:hi].tobytes(), SEED) for lo, hi in zip(edge[many].tolist(), edge[many + 1].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(named, np.uint64).view(np.int64), of[many])), pa.array(row[np.repeat(of > 1, of)])], names=["k", "row"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, row = (c.to_numpy() for c in batch.columns)
            if tail is not None:
                k, row = np.r_[tail[0], k], np.r_[tail[1], row]
            last = int(np.searchsorted(k, k[-1]))
            yield runs(k[:last], row[:last])
            tail = k[last:], row[last:]
        if tail is not None:
            yield runs(*tail)

    # buckets are named by their rows: those of the same rows become one (and two of one name together lose no pair)
    members = stored(gathered(keyed.mapInArrow(shared, "k long, row long").distinct(), count), "shared")
    held = members.count()
    members = stored(gathered(members.join(found.select("row", "size", "hist"), "row").select("k", "row", "size", "hist"), held), "members")
    reps = stored(gathered(reps.select("row", "fp", "size", "hist"), count), "representatives")
    near = _checked(_by_fingerprint(reps, RADIUS, count).union(_meet(members)).distinct(), rows, width, count)
    roots = stored(components(near, count), "first-roots")
    members = members.join(roots.withColumnRenamed("node", "row"), "row", "left").select("k", "row", "size", "hist", F.coalesce("root", "row").alias("label"))
    members = stored(gathered(members, held), "labelled")
    mixed = members.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("k")
    mixed = stored(gathered(mixed, held), "mixed")
    near = near.union(_checked(_meet(members.join(mixed, "k", "left_semi")), rows, width, count))
    roots = stored(components(near, count), "roots")
    stay = sets.join(roots, F.col("rep") == F.col("node"), "left").groupBy(F.coalesce("root", "rep").alias("root")).agg(F.min("best").alias("best"))
    gone = found.select("row").join(stay.select(F.col("best.row").alias("row")), "row", "left_anti").select(F.col("row").alias(at))
    gone = stored(gathered(gone, count), "gone")
    return copy.join(gone, at, "left_anti").drop(at)
