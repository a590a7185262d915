"""Quality rules by repetition coverage.

Words, lines and word n-grams are hashed with polynomial rolling hashes over prefix sums, modulo a prime, so the
hash of any span costs two lookups and a multiplication. Repeats are found by sorting the hashes of about a megabyte
of text at a time; spans whose hashes agree are then compared, so no collision counts as a repeat. A rule measures
which share of a text's word characters lies inside lines, or inside n-grams of a given length, that stood in the
same text before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.arrow_text import pieces, with_struct
from brindle.llm.scratch import free_name

#: The prime is 2^31 - 1; two bases make a key of 62 bits.
_P, _BASES = np.uint64((1 << 31) - 1), (1_103_515_245, 1_664_525_013)
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Bytes, or word ids, of spans that are compared at once.
_COMPARED = 1 << 20
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass(frozen=True)
class Rules:
    """Thresholds; a text is rejected beyond any of them."""

    min_words: int = 50
    max_repeat_words_pct: int = 50
    repeat_words_n: int = 3
    max_dup_line_share: float = 0.20
    #: n-gram length in words, and the largest share of word characters inside repeats of that length
    max_dup_ngram_share: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})

    def schema(self) -> T.StructType:
        longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in self.max_dup_ngram_share)]
        return T.StructType([*(T.StructField(c, T.LongType()) for c in longs), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])


def _folded(x: np.ndarray) -> np.ndarray:
    """A number below 2^31 + 4 for each x below 2^63, the same modulo 2^31 - 1; ``x`` is written over."""
    for _ in range(2):
        high = x >> np.uint64(31)
        x &= _P
        x += high
    return x


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^63; ``x`` is written over."""
    x = _folded(x)
    x -= _P * (x >= _P)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        some = min(done, n - done)
        out[done : done + some] = _mod(out[:some] * np.uint64(pow(base, done, int(_P))))
        done += some
    return out


class _Roll:
    """Hashes of any span of a sequence of symbols below 2^31 - 1."""

    _cache: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64),) * 2] * len(_BASES)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if len(self._cache[0][0]) <= n:
            size = 1 << max(16, n.bit_length())
            _Roll._cache = [(_powers(b, size), _powers(pow(b, -1, int(_P)), size)) for b in _BASES]
        self.powers = self._cache
        small = int(symbols.max(initial=0)) * n < 1 << 32  # then the sums stay below 2^63 without a remainder
        terms = ((lambda x: x) if small else _folded)
        self.sums = [np.r_[np.uint64(0), np.cumsum(terms(symbols * power[:n]), dtype=np.uint64)] for power, _ in self.powers]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = (_mod(_folded(sums[end] - sums[start]) * inverse[start]) for sums, (_, inverse) in zip(self.sums, self.powers, strict=True))
        return low | high << np.uint64(31)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _equal(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether symbols[a[i]:a[i] + size[i]] and symbols[b[i]:b[i] + size[i]] are equal."""
    out = np.ones(len(a), bool)
    upto = np.cumsum(size)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - size[lo] + _COMPARED, side="right")))
        if hi == lo + 1:
            out[lo] = np.array_equal(symbols[a[lo] : a[lo] + size[lo]], symbols[b[lo] : b[lo] + size[lo]])
        else:
            n = size[lo:hi]
            head = np.cumsum(n) - n
            at = np.arange(n.sum()) - np.repeat(head, n)
            differ = np.r_[0, np.cumsum(symbols[np.repeat(a[lo:hi], n) + at] != symbols[np.repeat(b[lo:hi], n) + at])]
            out[lo:hi] = differ[head + n] == differ[head]
        lo = hi
    return out


def _named(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], content: Callable[[int], object]) -> np.ndarray:
    """A name for each item, below twice their number: the same for equal items, and only for them.

    Equal items have equal ``keys``; ``same`` compares items pairwise, and ``content`` tells them apart where keys don't.
    """
    order = np.argsort(keys)
    sorted_keys = keys[order]
    tie = np.flatnonzero(sorted_keys[1:] == sorted_keys[:-1])
    run = np.ones(len(keys), np.int64)
    run[tie + 1] = 0
    run = np.cumsum(run) - 1
    names = np.empty(len(keys), np.int64)
    names[order] = run
    good = same(order[tie], order[tie + 1])
    for r in np.unique(run[tie[~good]]).tolist():
        seen: dict = {}
        lo, hi = np.searchsorted(run, [r, r + 1])
        for i in order[lo:hi].tolist():
            names[i] = seen.setdefault(content(i), len(keys) + i)
    return names


def _repeats(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, found before) for each name in order."""
    if not len(names):
        return np.zeros(0, bool), np.zeros(0, bool)
    at, most = np.arange(len(names)), int(names.max()) + 1
    first = np.zeros(most, np.int64)
    first[names[::-1]] = at[::-1]
    return np.bincount(names, minlength=most)[names] > 1, first[names] != at


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of ``width`` from one of the different ``starts``."""
    delta = np.zeros(n + 1, np.int32)
    delta[starts] += 1
    delta[starts + width] -= 1
    return np.cumsum(delta[:-1]) > 0


def measure(buf: np.ndarray, off: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """All figures for the texts ``buf[off[i]:off[i + 1]]``."""
    n, size = len(off) - 1, len(buf)
    filled = off[:-1] < off[1:]
    space, whole = _SPACE[buf], (buf & 0xC0) != 0x80
    opens, closes = np.ones(size, bool), np.ones(size, bool)
    opens[1:], closes[:-1] = space[:-1], space[1:]
    opens[off[:-1][filled]] = True
    closes[off[1:][filled] - 1] = True
    start, end = np.flatnonzero(~space & opens), np.flatnonzero(~space & closes) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    total = lambda flags: np.r_[0, np.cumsum(flags, dtype=np.int64)]
    letters = total(whole & ~space)
    chars = letters[end] - letters[start]
    by_doc = lambda weights, where: np.bincount(where, weights=weights, minlength=n).astype(np.int64)
    symbols = total(_SYMBOL[buf])
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": by_doc(chars, doc), "n_symbols": symbols[off[1:]] - symbols[off[:-1]]}

    bytes_roll = _Roll(buf.astype(np.uint64) + np.uint64(1))
    salt = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * _STEP

    newline = np.flatnonzero(buf == 10)
    line_start, line_end = np.sort(np.r_[off[:-1], newline + 1]), np.sort(np.r_[newline, off[1:]])
    line_doc = np.repeat(np.arange(n), np.diff(np.searchsorted(newline, off)) + 1)
    line_chars = letters[line_end] - letters[line_start]
    worded = np.flatnonzero(line_chars > 0)
    line_start, line_end, line_doc, line_chars = line_start[worded], line_end[worded], line_doc[worded], line_chars[worded]
    line_size = line_end - line_start
    span = _mix(bytes_roll.spans(line_start, line_end)) + line_size.astype(np.uint64)

    def same_line(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        alike = (line_doc[a] == line_doc[b]) & (line_size[a] == line_size[b])
        alike[alike] = _equal(buf, line_start[a[alike]], line_start[b[alike]], line_size[a[alike]])
        return alike

    _, before = _repeats(_named(_mix(span ^ salt[line_doc]), same_line, lambda i: (line_doc[i], buf[line_start[i] : line_end[i]].tobytes())))
    out["n_dup_lines"] = np.bincount(line_doc[before], minlength=n)
    out["dup_line_chars"] = by_doc(line_chars[before], line_doc[before])

    words, size = len(start), end - start

    def same_word(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        alike = size[a] == size[b]
        alike[alike] = _equal(buf, start[a[alike]], start[b[alike]], size[a[alike]])
        return alike

    word = _named(_mix(bytes_roll.spans(start, end)) + size.astype(np.uint64), same_word, lambda i: buf[start[i] : end[i]].tobytes())
    roll = _Roll(word.astype(np.uint64) + np.uint64(1))

    def windows(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.arange(max(0, words - width + 1))
        first = first[doc[first] == doc[first + width - 1]]
        held = doc[first]

        def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            alike = held[a] == held[b]
            for k in range(width):
                alike &= word[first[a] + k] == word[first[b] + k]
            return alike

        keys = _mix(roll.spans(first, first + width) ^ salt[held])
        return first, *_repeats(_named(keys, same, lambda i: (held[i], word[first[i] : first[i] + width].tobytes())))

    first, twice, _ = windows(rules.repeat_words_n)
    inside = _covered(first[twice], rules.repeat_words_n, words)
    out["n_repeat_words"] = np.bincount(doc[inside], minlength=n)
    for width in rules.max_dup_ngram_share:
        first, _, before = windows(width)
        inside = _covered(first[before], width, words)
        out[f"dup_{width}gram_chars"] = by_doc(chars[inside], doc[inside])

    failed = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_words_pct * out["n_words"])
    out["base_failed"] = failed
    bad = failed | (out["dup_line_chars"] > rules.max_dup_line_share * out["word_chars"])
    for width, most in rules.max_dup_ngram_share.items():
        bad |= out[f"dup_{width}gram_chars"] > most * out["word_chars"]
    out["kept"] = ~bad
    return out


def quality(df: DataFrame, text: str = "text", rules: Rules | None = None, name: str = "quality") -> DataFrame:
    """``df`` with a struct column of repetition figures and verdicts, one row for each row of ``df``.

    Words are runs of bytes other than ASCII white space. Null and empty texts have no words and fail the base
    rules. Texts of any length are read whole; repeated rows are judged alike. If ``df`` has a column called
    ``name``, underscores are put in front. An empty table gives an empty table.
    """
    rules = rules or Rules()
    kind = rules.schema()
    fields = [(f.name, pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64()) for f in kind.fields]

    def make(column: pa.Array) -> pa.Array:
        parts = [measure(buf, off, rules) for _, _, buf, off in pieces(column)]
        arrays = [pa.array(np.concatenate([p[f] for p in parts]) if parts else [], t) for f, t in fields]
        return pa.StructArray.from_arrays(arrays, names=[f for f, _ in fields])

    return with_struct(df, text, free_name(df, name), kind, make)


def keep_good(df: DataFrame, text: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows of ``df`` that pass all rules, with its columns.

    Null and empty texts go; texts of any length are read whole; repeated rows stay or go together. Columns of any
    name are carried along. An empty table stays empty.
    """
    name = free_name(df, "quality")
    return quality(df, text, rules, name).filter(F.col(name)["kept"]).select(*(F.col(f"`{c}`") for c in df.columns))
