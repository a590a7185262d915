"""Byte-pair encoding and decoding in batched numpy merge rounds.

A batch of texts is split into words by the tokenizer's pattern; each different word is encoded once. The
symbols of all words lie in one flat array. A round looks up every adjacent pair by binary search over the
sorted pair keys, takes the lowest rank in each word, and merges that pair wherever it stands in the word, from
the left. Words with nothing left to merge leave the array. A word of very many bytes would keep the rounds going for
itself alone, each over its whole length; such words are merged one by one, over a heap of their pairs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.arrow_text import tidy
from brindle.llm.scratch import free_name

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Different words that a worker remembers, the bytes of words that one run of rounds takes, and of a word that is merged alone.
REMEMBERED, ROUND_BYTES, LONG = 120_000, 1 << 20, 4096
_NONE = np.int64(1) << 40


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary, and that byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    return table | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class Bpe:
    """A byte-level BPE tokenizer read from a ``tokenizers`` JSON file."""

    def __init__(self, spec: dict):
        model, to_byte = spec["model"], byte_symbols()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.of_byte[b] = vocab[c]
        self.size = size
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        ranks, made = np.arange(len(pairs), dtype=np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, last = np.unique(keys[::-1], return_index=True)  # of a repeated pair the last rank counts
        self.keys, self.ranks, self.made = keys, ranks[::-1][last], made[::-1][last]
        self.made_of_rank = np.zeros(len(pairs), np.int64)
        self.made_of_rank[self.ranks] = self.made
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.shown = [str(i) for i in range(size)]
        self.pair: dict[int, int] = {}  # for long words only
        self._forget()

    def _forget(self) -> None:
        """The ids of all words known are in one pool; ``index`` says where a word stands in ``starts_of`` and ``sizes_of``."""
        self.index: dict[str, int] = {s: i for i, s in enumerate(self.special)}
        self.pool = np.array(list(self.special.values()), np.int32)
        self.starts_of, self.sizes_of = np.arange(len(self.special)), np.ones(len(self.special), np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, start, size of each) for (non-empty) words."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        sizes = np.array([len(w) for w in words], np.int64)
        ids = np.arange(len(words))
        rank = None
        while len(ids):
            head = np.r_[0, np.cumsum(sizes)[:-1]]
            if rank is None:
                rank = np.full(len(symbols), _NONE)
                rank[:-1] = self._rank(symbols[:-1], symbols[1:])
                rank[head + sizes - 1] = _NONE  # pairs don't cross words
            lowest = np.minimum.reduceat(rank, head)
            over = lowest == _NONE
            if over.any():
                stay = np.repeat(~over, sizes)
                done.append((ids[over], sizes[over], symbols[~stay]))
                symbols, rank = symbols[stay], rank[stay]
                ids, sizes, lowest = ids[~over], sizes[~over], lowest[~over]
                continue
            hit = rank == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            # of overlapping hits (a run of one symbol) every second one counts, from the left
            first = np.r_[True, np.diff(at) > 1]
            run = np.flatnonzero(first)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[nth % 2 == 0]
            word = np.searchsorted(head, at, side="right") - 1
            symbols = symbols.copy()
            symbols[at] = self.made_of_rank[lowest[word]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, rank = symbols[keep], rank[keep]
            sizes = sizes - np.bincount(word, minlength=len(sizes))
            tail = np.cumsum(sizes) - 1
            new = moved[at]
            ends = np.zeros(len(symbols), bool)
            ends[tail] = True
            mark = np.zeros(len(symbols), bool)
            mark[new] = True
            mark[new[new > 0] - 1] = True
            touched = np.flatnonzero(mark)
            inner = touched[~ends[touched]]
            rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
            rank[touched[ends[touched]]] = _NONE
        which, count, flat = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(3))
        start, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[which], size[which] = np.cumsum(count) - count, count
        return flat, start, size

    def merged_alone(self, word: bytes) -> np.ndarray:
        """The ids of one long word: the leftmost pair of lowest rank is merged until there is none."""
        if not self.pair:
            self.pair = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        symbols: list[int] = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbols)
        after, before, size, rank_of = [*range(1, n), -1], list(range(-1, n - 1)), self.size, self.pair.get
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank_of(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has been merged otherwise
            symbols[i], symbols[j] = int(self.made_of_rank[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right >= 0 and (found := rank_of(symbols[left] * size + symbols[right])) is not None:
                    heapq.heappush(heap, (found, left, symbols[left], symbols[right]))
        return np.array([x for x in symbols if x >= 0], np.int64)

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.index))
        if len(self.index) + len(new) > REMEMBERED:
            self._forget()
            new = list(words.difference(self.index))
        raw = [w.encode() for w in new]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG]
        flats, starts, sizes = [self.pool], np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        end, lo = len(self.pool), 0
        while lo < len(short):
            hi, size = lo, 0
            while hi < len(short) and (hi == lo or size + len(raw[short[hi]]) <= ROUND_BYTES):
                size += len(raw[short[hi]])
                hi += 1
            at = short[lo:hi]
            flat, start, count = self.merged([raw[i] for i in at])
            starts[at], sizes[at] = start + end, count
            flats.append(flat.astype(np.int32))
            end, lo = end + len(flat), hi
        for i in (i for i, r in enumerate(raw) if len(r) > LONG):
            flat = self.merged_alone(raw[i])
            starts[i], sizes[i] = end, len(flat)
            flats.append(flat.astype(np.int32))
            end += len(flat)
        if new:
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new)), strict=True))
            self.pool, self.starts_of, self.sizes_of = np.concatenate(flats), np.r_[self.starts_of, starts], np.r_[self.sizes_of, sizes]

    def _words(self, text: str) -> list[str]:
        if self.cut is None:
            return self.split.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.split.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them); special tokens in a text are recognised."""
        split = [self._words(t) for t in texts]
        self._learn(set().union(*split))
        at = np.array(list(map(self.index.__getitem__, chain.from_iterable(split))), np.int64)
        sizes = self.sizes_of[at]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = self.pool[np.repeat(self.starts_of[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.cumsum([0, *map(len, split)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.lengths[ids]
        ends = np.r_[0, np.cumsum(sizes)]
        raw = self.flat[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[offsets].tolist()
        return [raw[a:b].decode("utf-8", errors="replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def joined(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The decimal ids of each run, joined by commas."""
        shown, cuts = list(map(self.shown.__getitem__, ids.tolist())), offsets.tolist()
        return [",".join(shown[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def _parsed(spec: str) -> Bpe:
    return Bpe(json.loads(spec))


def load(path: str) -> str:
    """The tokenizer file's text. It is read on the driver and sent with the tasks: its size is fixed, about 1.4 MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(df: DataFrame, path: str, text: str = "text", name: str = "bpe", with_ids: bool = True) -> DataFrame:
    """``df`` with a struct column: n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids.

    Null counts as an empty text, of no tokens. A text is read whole, however long. Repeated rows get the same
    result. Columns of any name are carried along; if one is called ``name``, underscores are put in front. An empty
    table gives an empty table.
    """
    name = free_name(df, name)
    spec = df.sparkSession.sparkContext.broadcast(load(path))
    fields = "n_tokens: bigint, ids_sha256: string, decoded_sha256: string" + (", ids: array<int>" if with_ids else "")
    kind = df.withColumn(name, F.lit(None).cast(f"struct<{fields}>")).schema
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _parsed(spec.value)
        digests = lambda texts: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
        try:
            for batch in batches:
                for lo, hi in _parts(batch.column(at)):
                    part = batch.slice(lo, hi - lo)
                    ids, offsets = bpe.encode([t or "" for t in part.column(at).to_pylist()])
                    columns = {"n_tokens": pa.array(np.diff(offsets)), "ids_sha256": digests(bpe.joined(ids, offsets)), "decoded_sha256": digests(bpe.decode(ids, offsets))}
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                    made = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
                    yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])
        finally:
            bpe._forget()  # an idle worker keeps the tokenizer, not the words

    return df.mapInArrow(tidy(run), kind)


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about a megabyte of text; a longer text is a run of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + ROUND_BYTES, side="right")))
        yield lo, hi
        lo = hi


def decoded(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids (null: an empty text); bytes that are no UTF-8 become U+FFFD.

    Columns of any name are carried along; if one is called ``name``, underscores are put in front.
    """
    name = free_name(df, name)
    spec = df.sparkSession.sparkContext.broadcast(load(path))
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _parsed(spec.value)
        for batch in batches:
            rows = [i or [] for i in batch.column(at).to_pylist()]
            texts = bpe.decode(np.array([x for r in rows for x in r], np.int64), np.cumsum([0, *map(len, rows)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, df.withColumn(name, F.lit("")).schema)
