"""Removal of repeated byte strings over the whole corpus, by suffix arrays of shards.

Two equal strings of WIDTH bytes have the same smallest hash among their K-byte substrings. So every string is
dealt to the shard of its smallest hash, and equal strings meet in one shard; runs of neighbouring strings with
the same hash travel as one segment. Hashes that occur once in the corpus need no shard. A shard's suffixes are
put in order by external induced sorting; strings whose common prefix with a neighbour is WIDTH or more are
repeated, and the bytes of all repeated strings go.

Segments that a task sees more than once travel once, with their number: a passage that a third of all documents
share is no larger a shard than any other. A table of occurrences leads back from segments to documents.

A hash may still have more different segments than a shard should hold: those around a passage that many documents
share, each with other text beside it. They are split by where the hash lies in a string. Strings that have it at
offsets lo to hi - 1 all contain lo bytes before it and a fixed number after it, and equal strings agree in these;
so these bytes are the new key, and keys still too large have their range halved again. At one offset the bytes
are the whole string, and all pieces of a key are equal: no shard outgrows a worker, and nothing is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.arrow_text import pieces, tidy
from brindle.llm.induced_sort import repeated
from brindle.llm.scratch import discard, free_name, numbered, stored

WIDTH, K = 200, 24
#: Strings in a segment at most, bytes of text in a shard (a single larger group of segments is a shard of its
#: own), and bytes of one text that are hashed at once.
SEGMENT, SHARD, PIECE = 2048, 1 << 21, 1 << 22
#: Bytes of segments with one hash from which on they are split.
HOT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 24) - 1)


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = 1 << max(16, int(n).bit_length())
            fill = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)], dtype=np.uint64)
            cls.up, cls.down = fill(np.uint64(_BASE)), fill(np.uint64(pow(_BASE, -1, 1 << 64)))
        return cls.up, cls.down


def anchors(buf: np.ndarray, width: int = WIDTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the smallest hash in each string of ``width`` bytes; of equal hashes, the last place."""
    n, window = len(buf), width - k + 1
    up, down = _Powers.of(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[:n], out=sums[1:])
    m = n - k + 1
    h = (sums[k:] - sums[:m]) * down[:m]
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h ^= h >> np.uint64(29)
    key = (h & ~_LOW) | (_LOW - np.arange(m, dtype=np.uint64))
    padded = np.full(-(-m // window) * window, ~np.uint64(0))
    padded[:m] = key
    rows = padded.reshape(-1, window)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = m - window + 1
    place = (_LOW - (np.minimum(after[:strings], upto[window - 1 : window - 1 + strings]) & _LOW)).astype(np.int64)
    return h[place], place


def runs(buf: np.ndarray, off: np.ndarray, width: int = WIDTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(text, first string, strings, hash, weight, place) of all runs; weight 2 if equal strings may be in one run.

    ``off`` are the offsets of the texts in ``buf``; first string counts from the start of the text. ``place`` is where
    the hash lies, from the first string on; -1 if it lies at several places.
    """
    if len(buf) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    least, place = anchors(buf, width, k)
    strings = len(place)
    text = np.searchsorted(off, np.arange(strings), side="right") - 1
    whole = np.arange(strings) + width <= off[text + 1]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])])
    end = np.r_[new[1:], strings]
    keep = whole[new]
    new, end = new[keep], end[keep]
    several = place[new] != place[end - 1]
    return text[new], new - off[text[new]], end - new, least[new].view(np.int64), 1 + several.astype(np.int64), np.where(several, -1, place[new] - new)


def split(segment: bytes, anchor: int, lo: int, hi: int, width: int = WIDTH, k: int = K) -> Iterator[tuple[int, bytes, int, int, int, int]]:
    """(start in the segment, piece, anchor, lo, hi, key) of the pieces that hold the segment's strings, each once.

    ``anchor`` is the place of the hash in all strings, and ``lo`` to ``hi - 1`` are its offsets in them. Below 0
    it is unknown: then the strings may have the hash at several places.
    """
    if anchor < 0:
        _, place = anchors(np.frombuffer(segment, np.uint8), width, k)
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
        groups = list(zip(place[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        lo, hi = 0, width - k + 1
    else:
        groups = [(anchor, 0, len(segment) - width + 1)]
    middle = (lo + hi) // 2
    for place, first, end in groups:
        for a, b in ((lo, middle), (middle, hi)):
            start, stop = max(first, place - b + 1), min(end, place - a + 1)
            if start < stop:
                common = segment[place - a : place - b + 1 + width]
                key = int.from_bytes(hashlib.md5(common + b"%d %d" % (a, b)).digest()[:8], "little", signed=True)
                yield start, segment[start : stop - 1 + width], place - start, a, b, key


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    """(row, h, first, strings, weight, place) of all runs of ``docs`` (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for lo, _, buf, off in pieces(batch.column(1), PIECE):
                for at in range(0, max(1, len(buf)), PIECE) if len(off) == 2 else (0,):
                    part = buf[at : at + PIECE + width - 1] if len(off) == 2 else buf
                    text, first, strings, h, weight, place = runs(part, off if len(off) > 2 else np.array([0, len(part)]), width)
                    arrays = [rows[lo + text], h, (first + at).astype(np.int32), strings.astype(np.int32), weight.astype(np.int8), place.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["row", "h", "first", "strings", "weight", "place"])

    return docs.mapInArrow(tidy(run), "row long, h long, first int, strings int, weight byte, place int")


def _segments(found: DataFrame, width: int) -> DataFrame:
    """Of (row, text, runs): rows of kind 0 (h, id, segment, copies, place), once for each batch, and of kind 1 (id, row, first)."""
    kind = "kind int, h long, id binary, segment binary, copies long, place int, row long, first int"
    schema = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("id", pa.binary()), ("segment", pa.binary()), ("copies", pa.int64()), ("place", pa.int32()), ("row", pa.int64()), ("first", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                texts: dict[bytes, list] = {}
                ids, rows, firsts = [], [], []
                for row, text, each in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for x in each:
                        h, end, place = x["h"], x["first"] + x["strings"], x["place"]
                        for first in range(x["first"], end, SEGMENT):
                            segment = text[first : min(end, first + SEGMENT) + width - 1]
                            key = hashlib.md5(segment).digest()
                            if (known := texts.get(key)) is None:
                                texts[key] = [h, segment, 1, place - (first - x["first"]) if place >= 0 else -1]
                            else:
                                known[2] += 1
                            ids.append(key)
                            rows.append(row)
                            firsts.append(first)
                n, m = len(texts), len(ids)
                held = list(texts.values())
                yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([x[0] for x in held], pa.int64()), pa.array(list(texts), pa.binary()), pa.array([x[1] for x in held], pa.binary()), pa.array([x[2] for x in held], pa.int64()), pa.array([x[3] for x in held], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(rows, pa.int64()), pa.array(firsts, pa.int32())], schema=schema)

    return found.mapInArrow(tidy(run), kind)


def _pieces(hot: DataFrame, width: int) -> DataFrame:
    """Of (id, segment, copies, anchor, lo, hi): rows of kind 0 (h, id, segment, copies, anchor, lo, hi), once for each batch, and of kind 1 (parent, id, at: all its places in the parent)."""
    names = ["kind", "h", "id", "segment", "copies", "anchor", "lo", "hi", "parent", "at"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                held: dict[bytes, list] = {}
                links = []
                for parent, segment, copies, *where in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns), strict=True):
                    places: dict[bytes, list[int]] = {}
                    for at, piece, anchor, a, b, key in split(segment, *where, width):
                        digest = hashlib.md5(piece).digest()
                        held.setdefault(digest, [0, key, digest, piece, 0, anchor, a, b, None, None])[4] += copies
                        places.setdefault(digest, []).append(at)
                    # a piece that is all of its parent needs no link: it has the same id
                    links += ([1, None, digest, None, None, None, None, None, parent, at] for digest, at in places.items() if digest != parent)
                rows = [*held.values(), *links]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], schema=schema)

    return hot.select("id", "segment", "copies", "anchor", "lo", "hi").mapInArrow(run, "kind int, h long, id binary, segment binary, copies long, anchor int, lo int, hi int, parent binary, at array<int>")


def _spread(segments: DataFrame, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """(segments and pieces (h, id, segment, copies, place) with at most about HOT bytes to an ``h``, links (parent, id, at) of each level)."""
    level = segments.select("h", "id", "segment", "copies", "place", F.lit(-1).alias("anchor"), F.lit(0).alias("lo"), F.lit(width).alias("hi"))
    ready, links = [], []
    for depth in range(width.bit_length() + 2):
        large = level.groupBy("h").agg(F.sum(F.length("segment")).alias("n"), F.max(F.col("hi") - F.col("lo")).alias("span"))
        large = stored(large.filter((F.col("n") > HOT) & (F.col("span") > 1)).select("h"), "hot-hashes")
        if large.isEmpty():
            break
        ready.append(level.join(large, "h", "left_anti"))
        hot = level.join(large, "h", "left_semi")
        if depth:
            made = stored(_pieces(hot, width), "pieces", partition_by=["kind"])
            links.append(made.filter("kind = 1").select("parent", "id", "at"))
            hot = made.filter("kind = 0").withColumn("place", F.col("anchor"))
        # the first time, copies from different batches are put together only: often that is enough
        rest = [F.first(c).alias(c) for c in ("h", "segment", "place", "anchor", "lo", "hi")]
        level = stored(hot.groupBy("id").agg(F.sum("copies").alias("copies"), *rest), "hot-segments")
    columns = ["h", "id", "segment", "copies", "place"]
    return reduce(DataFrame.union, [r.select(columns) for r in [*ready, level]]), links


def _hopeful(group: dict[bytes, list], width: int, k: int = K) -> dict[bytes, list]:
    """Of the segments (segment, copies, place) with one hash, those that may share a string with another, or with themselves.

    Equal strings have the hash at the same offset. Of the other bytes of a string half or more lie to one side of it,
    so the two segments agree in that many bytes on that side of the hash.
    """
    if any(place < 0 for _, _, place in group.values()):
        return group
    half, sides = (width - k + 1) // 2, []
    count: dict[tuple[bool, bytes], int] = {}
    for segment, copies, place in group.values():
        found = []
        if place >= half:
            found.append((False, segment[place - half : place]))
        if len(segment) >= place + k + half:
            found.append((True, segment[place + k : place + k + half]))
        for side in found:
            count[side] = count.get(side, 0) + copies
        sides.append(found)
    return {key: x for (key, x), found in zip(group.items(), sides, strict=True) if any(count[side] > 1 for side in found)}


def _judged(segments: DataFrame, width: int) -> DataFrame:
    """(id, spans): of each segment (h, id, segment, copies, place) with repeated strings, the bytes that they cover."""
    kind = "id binary, spans array<struct<start: int, end: int>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def shard(held: dict[bytes, list]) -> pa.RecordBatch:
        ids, out = [], []
        if held:
            starts = repeated([x[0] for x in held.values()], np.array([x[1] for x in held.values()]), width)
            for key, at in zip(held, starts, strict=True):
                if len(at):
                    gap = np.flatnonzero(np.diff(at) > width)
                    ids.append(key)
                    out.append([{"start": a, "end": b} for a, b in zip(at[np.r_[0, gap + 1]].tolist(), (at[np.r_[gap, len(at) - 1]] + width).tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, span)], names=["id", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        group: dict[bytes, list] = {}
        size, last = 0, None

        def close() -> None:
            nonlocal size
            for key, x in _hopeful(group, width).items():
                if key in held:
                    held[key][1] += x[1]
                else:
                    held[key] = x
                    size += len(x[0])
            group.clear()

        for batch in batches:
            for h, key, segment, copies, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != last:
                    close()
                    if size >= SHARD:
                        yield shard(held)
                        held, size = {}, 0
                last = h
                if key in group:
                    group[key][1] += copies
                else:
                    group[key] = [segment, copies, place]
        close()
        yield shard(held)

    rows = segments.select("h", "id", "segment", "copies", "place").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(tidy(run), kind)


def _spans(df: DataFrame, text: str, width: int) -> tuple[DataFrame, str, DataFrame]:
    """(rows with their text, the column that numbers them, (row, spans) of the rows that lose bytes)."""
    docs, at = numbered(df)
    own = docs.select(F.col(at).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    anchors = stored(_anchors(own, width), "anchors")
    again = stored(anchors.groupBy("h").agg(F.sum("weight").alias("n")).filter("n > 1").select("h"), "repeated-hashes")
    found = anchors.join(again, "h").groupBy("row").agg(F.collect_list(F.struct("h", "first", "strings", "place")).alias("runs"))
    found = stored(found, "runs")
    discard(anchors, again)
    segments = stored(_segments(own.join(found, "row").select("row", "text", "runs"), width), "segments", partition_by=["kind"])
    discard(found)
    ready, links = _spread(segments.filter("kind = 0"), width)
    judged = stored(_judged(ready, width), "judged")
    for link in reversed(links):  # what a piece says of its bytes holds for its parent's
        moved = F.flatten(F.transform("at", lambda a: F.transform("spans", lambda s: F.struct((s["start"] + a).alias("start"), (s["end"] + a).alias("end")))))
        judged = stored(judged.union(link.join(judged, "id").select(F.col("parent").alias("id"), moved.alias("spans"))), "judged")
    places = segments.filter("kind = 1").select("id", "row", "first").join(judged, "id").select("row", F.explode(F.transform("spans", lambda s: F.struct((s["start"] + F.col("first")).alias("start"), (s["end"] + F.col("first")).alias("end")))).alias("span"))
    return docs, at, stored(places.groupBy("row").agg(F.collect_set("span").alias("spans")), "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def strip_repeats(df: DataFrame, text: str = "text", name: str = "stripped", width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """``df`` with a struct column: n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the bytes kept and the spans removed.

    Texts are read as UTF-8 bytes, null as empty. A byte goes if a ``width``-byte string that covers it also
    starts anywhere else, in the same text or another; strings never cross texts and are judged on the input.
    Texts shorter than ``width`` stay as they are; all copies of a longer text, repeated rows too, go entirely. A
    text of any length is read whole, in pieces. Rows are numbered in a stored copy of ``df``, so nothing depends on
    how it lists them. Columns of any name are carried along; if one is called ``name``, underscores are put in front.
    An empty table gives an empty table.
    """
    docs, number, spans = _spans(df, text, width)
    name, gaps = free_name(df, name), free_name(df, "spans_of_row")
    rows = docs.join(spans.select(F.col("row").alias(number), F.col("spans").alias(gaps)), number, "left").drop(number)
    fields = "n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string" + (", kept: binary, removed: array<struct<start: int, end: int>>" if with_text else "")
    at, spot = rows.columns.index(text), rows.columns.index(gaps)
    schema = rows.drop(gaps).withColumn(name, F.lit(None).cast(f"struct<{fields}>")).schema
    if not with_text:
        schema = T.StructType([f for i, f in enumerate(schema.fields) if i != at])
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))] if with_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, made = batch.slice(lo, 500), []
                for data, found in zip(part.column(at).cast(pa.binary()).to_pylist(), part.column(spot).to_pylist(), strict=True):
                    data, gone = data or b"", merged(found or [])
                    edges = [0, *(x for pair in gone for x in pair), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else data
                    row = {"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                    made.append(row | ({"kept": kept, "removed": [{"start": a, "end": b} for a, b in gone]} if with_text else {}))
                columns = [c for i, c in enumerate(part.columns) if i != spot and (with_text or i != at)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, kind)], names=schema.names)

    return rows.mapInArrow(tidy(run), schema)
