"""Suffix order of one shard by external induced sorting.

Suffixes are larger (L) or smaller (S) than the one after them; an S suffix after an L one is a star. Stars are
named by the substring up to the next star, and ordered by these names: by recursion, which sorts the text of names
the same way, or, by default, by doubling the names until they span the depth that is asked for. Both give one order
of that depth; the recursion goes name by name, where numpy has nothing to do at once, and takes some seven times as
long (the README has the figures). All other suffixes are induced: a scan in order hands each suffix's predecessor on to the
queue of its first byte. Each queue gets its entries in order, so the 258 first-in-first-out queues are a
priority queue on (byte, rank). An entry is a tuple of a suffix and the symbols that it has in common with the
entry before it: one more than the least common prefix that the scan passed between the two that induced them.
Queues spill to an unlinked temp file beyond a memory budget and are read block by block; only the text and two
bits of type for each byte stay in memory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import accumulate

import numpy as np

#: Entries that a scan takes at once, and bytes that the queues of a shard may hold in memory.
BLOCK, MEMORY = 1 << 18, 1 << 27
SEPARATOR = 1
SYMBOLS = 258  # end, separator, 256 bytes


class Spill:
    """Memory of all queues of a shard, and the file for what goes beyond it."""

    def __init__(self, memory: int = MEMORY):
        self.free, self.file, self.end = memory, None, 0

    def put(self, part: np.ndarray) -> np.ndarray | tuple[int, int]:
        if part.nbytes <= self.free:
            self.free -= part.nbytes
            return part
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        self.file.write(np.ascontiguousarray(part).data)
        at, self.end = self.end, self.end + part.nbytes
        return at, len(part)

    def get(self, part: np.ndarray | tuple[int, int], kind: np.dtype) -> np.ndarray:
        if isinstance(part, tuple):
            self.file.seek(part[0])
            return np.frombuffer(self.file.read(part[1] * kind.itemsize), kind)
        return part

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


#: An entry as one integer: the suffix's position above PREFIX bits of common prefix.
PREFIX, TUPLE = 16, np.dtype(np.int64)
Block = tuple[np.ndarray, np.ndarray]  # positions, common prefixes with the entries before


class Queue:
    """Suffix tuples in the order in which they were put."""

    def __init__(self, spill: Spill):
        self.spill, self.parts, self.sizes, self.read = spill, [], [], 0

    def put(self, at: np.ndarray, prefix: np.ndarray) -> None:
        self.parts.append(self.spill.put(at.astype(TUPLE) << PREFIX | prefix))
        self.sizes.append(len(at))

    def take(self) -> Block | None:
        """The next block; entries stay, for later scans."""
        if self.read == len(self.parts):
            return None
        lo, size = self.read, 0
        while self.read < len(self.parts) and (self.read == lo or size + self.sizes[self.read] <= BLOCK):
            size += self.sizes[self.read]
            self.read += 1
        return self._joined(lo, self.read)

    def _joined(self, lo: int, hi: int) -> Block:
        found = [self.spill.get(p, TUPLE) for p in self.parts[lo:hi]]
        found = found[0] if len(found) == 1 else np.concatenate(found)
        return found >> PREFIX, found & ((1 << PREFIX) - 1)

    def backwards(self, prefix: int = 0) -> Iterator[Block]:
        """Blocks from the end, each reversed; ``prefix`` is what the last entry shares with the one scanned before it."""
        hi = len(self.parts)
        while hi:
            lo, size = hi - 1, self.sizes[hi - 1]
            while lo and size + self.sizes[lo - 1] <= BLOCK:
                lo -= 1
                size += self.sizes[lo]
            at, shared = self._joined(lo, hi)
            yield at[::-1], np.r_[prefix, shared[:0:-1]]
            prefix, hi = shared[0], lo


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one is."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    small = np.ones(n, bool)
    if len(differs):
        lengths = np.diff(np.r_[-1, differs])
        small[: differs[-1] + 1] = np.repeat(text[differs] < text[differs + 1], lengths)
        small[differs[-1] + 1 :] = False
    small[-1] = True
    return small


class Prefixes:
    """Common prefixes of suffixes of ``text``, up to ``depth`` symbols; none are looked at for depth 0."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, self.size = min(depth, (1 << PREFIX) - 1), len(text)
        self.words = np.ndarray((len(text),), "<u8", np.r_[text, np.zeros(4, text.dtype)], 0, (2,)) if depth else None  # 4 symbols each

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By comparing the symbols of a[i] and b[i], which differ."""
        out = np.full(len(a), self.depth, TUPLE)
        pair = np.arange(len(a))
        for step in range(0, self.depth, 4):
            differ = self.words[a[pair] + step] ^ self.words[b[pair] + step]
            ends = np.flatnonzero(differ)
            lowest = differ[ends] & (~differ[ends] + np.uint64(1))
            out[pair[ends]] = np.minimum(self.depth, step + (np.frexp(lowest.astype(float))[1] - 1) // 16)
            pair = pair[differ == 0]
            if not len(pair):
                break
        return out

    def seam(self, a: np.ndarray | None, b: np.ndarray | None) -> int:
        """Of the end of one scanned array and the start of the next in the same bucket; 0 if there is none."""
        return 0 if a is None or b is None or not self.depth else int(self.between(a[-1:], b[:1])[0])


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo[i]] to values[hi[i]], inclusive, over spans of doubling length."""
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out, table = np.empty(len(lo), values.dtype), values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


class Scan:
    """A pass over suffixes in order that hands on the predecessors of one type to ``to``, with their prefixes."""

    def __init__(self, text: np.ndarray, small: np.ndarray, wanted: bool, to: list[Queue], prefixes: Prefixes):
        self.text, self.small, self.wanted, self.to, self.prefixes = text, small, wanted, to, prefixes
        self.since = np.full(SYMBOLS, -1, TUPLE)  # least prefix passed since each queue's last entry; -1: it has none

    def block(self, at: np.ndarray, shared: np.ndarray) -> None:
        source = np.flatnonzero(at > 0)
        found = at[source] - 1
        fits = self.small[found] == self.wanted
        source, found = source[fits], found[fits]
        symbols = self.text[found]
        order = np.argsort(symbols, kind="stable")
        source, found, symbols = source[order], found[order], symbols[order]
        heads = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])[: len(symbols)]
        prefix = self._handed(shared, source, heads, symbols[heads]) if self.prefixes.depth else np.zeros(len(found), TUPLE)
        for lo, hi, symbol in zip(heads.tolist(), [*heads[1:].tolist(), len(found)], symbols[heads].tolist(), strict=False):
            self.to[symbol].put(found[lo:hi], prefix[lo:hi])

    def _handed(self, shared: np.ndarray, source: np.ndarray, heads: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        if not len(source):
            np.minimum(self.since, shared.min(), out=self.since)
            return source
        lo = np.r_[0, source[:-1] + 1]
        lo[heads] = 0
        out = _least(shared, lo, source)
        out[heads] = np.minimum(out[heads], self.since[symbols])
        np.minimum(self.since, shared.min(), out=self.since)
        after = np.r_[np.minimum.accumulate(shared[::-1])[::-1], self.prefixes.depth]
        self.since[symbols] = after[source[np.r_[heads[1:], len(source)] - 1] + 1]
        return np.minimum(out + 1, self.prefixes.depth)


def _induce(text: np.ndarray, small: np.ndarray, stars: np.ndarray, prefixes: Prefixes, spill: Spill) -> tuple[list[Queue], list[Queue]]:
    """(L suffixes ascending, S suffixes descending) by first symbol, from the stars in the order given."""
    star, large, less = ([Queue(spill) for _ in range(SYMBOLS)] for _ in range(3))
    shared = np.zeros(len(stars), TUPLE)
    if prefixes.depth:
        shared[1:] = prefixes.between(stars[:-1], stars[1:])
    symbols = text[stars]
    order = np.argsort(symbols, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(symbols[order].astype(np.int32)) != 0])
    for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(stars)], strict=True):
        star[symbols[order[lo]]].put(stars[order[lo:hi]], shared[order[lo:hi]])

    scan = Scan(text, small, False, large, prefixes)
    for symbol in range(SYMBOLS):
        last = None
        while (block := large[symbol].take()) is not None:
            scan.block(*block)
            last = block[0]
        while (block := star[symbol].take()) is not None:
            if last is not None:
                block[1][0] = prefixes.seam(last, block[0])
                last = None
            scan.block(*block)
    scan = Scan(text, small, True, less, prefixes)
    for symbol in reversed(range(SYMBOLS)):
        last = None
        while (block := less[symbol].take()) is not None:
            scan.block(*block)
            last = block[0]
        for block in large[symbol].backwards():
            if last is not None:
                block[1][0] = prefixes.seam(last, block[0])
                last = None
            scan.block(*block)
    return large, less


def _named(text: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each star substring of ``order`` differs from the one before it."""
    new = np.ones(len(order), bool)
    pair = np.flatnonzero(length[1:] == length[:-1]) + 1
    step = 0
    while len(pair):
        pair = pair[text[order[pair] + step] == text[order[pair - 1] + step]]
        done = length[pair] == step
        new[pair[done]] = False
        pair = pair[~done]
        step += 1
    return new


def _by_recursion(names: list[int], kinds: int) -> list[int]:
    """The places of ``names`` in the order of their suffixes; the last name is the only 0, and there are ``kinds`` of them."""
    n = len(names)
    if kinds == n:
        out = [0] * n
        for i, x in enumerate(names):
            out[x] = i
        return out
    small = bytearray(n)
    small[-1] = 1
    for i in range(n - 2, -1, -1):
        small[i] = names[i] < names[i + 1] or (names[i] == names[i + 1] and small[i + 1])
    stars = [i for i in range(1, n) if small[i] and not small[i - 1]]
    count = [0] * (kinds + 1)
    for x in names:
        count[x + 1] += 1
    starts = list(accumulate(count))

    def induced(order: list[int]) -> list[int]:
        out, ends = [-1] * n, starts[1:]
        for i in reversed(order):
            ends[names[i]] -= 1
            out[ends[names[i]]] = i
        heads = starts[:-1]
        for i in out:  # grows ahead of the scan
            if i > 0 and not small[i - 1]:
                out[heads[names[i - 1]]] = i - 1
                heads[names[i - 1]] += 1
        ends = starts[1:]
        for at in range(n - 1, -1, -1):
            i = out[at]
            if i > 0 and small[i - 1]:
                ends[names[i - 1]] -= 1
                out[ends[names[i - 1]]] = i - 1
        return out

    is_star = bytearray(n)
    for i in stars:
        is_star[i] = 1
    after = dict(zip(stars, [*stars[1:], n - 1], strict=True))
    label, last, now = {}, None, -1
    for i in induced(stars):
        if is_star[i]:
            now += last is None or names[last : after[last] + 1] != names[i : after[i] + 1]
            label[i], last = now, i
    order = _by_recursion([label[i] for i in stars], now + 1)
    return induced([stars[k] for k in order])


def _star_order(text: np.ndarray, small: np.ndarray, stars: np.ndarray, depth: int, spill: Spill, recursive: bool = False) -> np.ndarray:
    """The stars, given by position, in the order of their suffixes' first ``depth`` symbols."""
    m = len(stars)
    if m < 2:
        return stars
    _, less = _induce(text, small, stars, Prefixes(text, 0), spill)
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    found = [stars[-1:]]  # the end is the smallest
    for queue in less:
        for block, _ in queue.backwards():
            found.append(block[is_star[block]])
    order = np.concatenate(found)
    nth = np.zeros(len(text), stars.dtype)
    nth[stars] = np.arange(m)
    index = nth[order].astype(np.int64)
    length = np.r_[np.diff(stars), 0][index]
    new = _named(text, order, length)
    if recursive:
        names = np.empty(m, np.int64)
        names[index] = np.cumsum(new) - 1
        return stars[_by_recursion(names.tolist(), int(names.max()) + 1)]
    head = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    rank = np.empty(m + 1, np.int64)
    rank[index], rank[m] = head, -1  # names are the place of the first of equals
    span, active = 1, index[(np.r_[~new[1:], False]) | ~new]
    while len(active) and 2 * span <= 2 * depth:
        key = rank[active] * (m + 2) + rank[np.minimum(active + span, m)] + 1
        by = np.argsort(key)
        active, key, was = active[by], key[by], rank[active[by]]
        at = np.arange(len(active))
        opens = np.r_[True, was[1:] != was[:-1]]
        fresh = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(opens, at, 0))
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = was + first - group
        active = active[~fresh | np.r_[~fresh[1:], False]]
        span *= 2
    return stars[np.argsort(rank[:m], kind="stable")]


def suffix_order(text: np.ndarray, depth: int, memory: int = MEMORY, recursive: bool = False) -> Iterator[Block]:
    """Blocks of (positions, symbols in common with the suffix before, up to ``depth``) of all suffixes but the last.

    They are ordered by their first ``depth`` symbols. ``text`` has symbols below SYMBOLS and ends with the only 0.
    """
    small, prefixes = _types(text), Prefixes(text, depth)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    spill = Spill(memory)
    try:
        stars = _star_order(text, small, stars, depth, spill, recursive)
    finally:
        spill.close()
    spill = Spill(memory)
    try:
        large, less = _induce(text, small, stars, prefixes, spill)
        for symbol in range(SYMBOLS):
            large[symbol].read, last = 0, None
            while (block := large[symbol].take()) is not None:
                yield block
                last = block[0]
            for block in less[symbol].backwards():
                if last is not None:
                    block[1][0] = prefixes.seam(last, block[0])
                    last = None
                yield block
    finally:
        spill.close()


def repeated(segments: list[bytes], copies: np.ndarray, width: int, memory: int = MEMORY, recursive: bool = False) -> list[np.ndarray]:
    """For each segment the starts of its ``width``-byte strings that start elsewhere too, ascending.

    A segment given once may stand for more ``copies``; all its strings are repeated then.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    joined = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8)
    text = joined.astype(np.uint16) + np.uint16(2)
    start = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    text[start + sizes] = SEPARATOR
    text[-1] = 0
    whole = np.zeros(len(text), bool)  # starts of strings that end within their segment
    delta = np.zeros(len(text) + 1, np.int32)
    usable = sizes >= width
    delta[start[usable]] += 1
    delta[(start + sizes - width + 1)[usable]] -= 1
    whole[:] = np.cumsum(delta[:-1]) > 0
    again = np.zeros(len(text), bool)
    last = np.zeros(1, TUPLE)
    for at, shared in suffix_order(text, width, memory, recursive):
        hit = shared >= width  # if one of the two is whole, both are
        again[at[hit]] = True
        again[np.r_[last, at[:-1]][hit]] = True
        last = at[-1:]
    again &= whole
    for i in np.flatnonzero((copies > 1) & usable):
        again[start[i] : start[i] + sizes[i] - width + 1] = True
    return [np.flatnonzero(again[a : a + n]) for a, n in zip(start.tolist(), sizes.tolist(), strict=True)]
