import os
import random

import numpy as np
import pytest

from brindle.llm.induced_sort import repeated, suffix_order


def encode(segments):
    out = []
    for s in segments:
        out += [b + 2 for b in s] + [1]
    return np.array([*out, 0], np.uint16)


@pytest.mark.parametrize("recursive", [False, True])
@pytest.mark.parametrize("memory", [0, 1 << 20])
def test_order(memory, recursive):
    rng = random.Random(1)
    for trial in range(150):
        alphabet = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        text = encode([bytes(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 6))])
        depth = rng.choice([400, 400, 5, 1])
        blocks = list(suffix_order(text, depth, memory, recursive))
        got, shared = (np.concatenate([*(b[i] for b in blocks), np.zeros(0, np.int64)]).tolist() for i in (0, 1))
        heads = [text[i : i + depth].tolist() for i in got]
        assert sorted(got) == list(range(len(text) - 1)) and heads == sorted(heads), trial
        assert shared == [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(heads, heads[1:], strict=False))][: len(got)], trial


def test_repeated_strings():
    rng = random.Random(2)
    for width in (8, 20, 33):
        for _ in range(60):
            base = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(150)))
            segments = [base[rng.randrange(len(base) + 1) :] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 7))]
            copies = np.array([rng.choice([1, 1, 1, 3]) for _ in segments])
            count = {}
            for s, n in zip(segments, copies, strict=True):
                for i in range(len(s) - width + 1):
                    count[s[i : i + width]] = count.get(s[i : i + width], 0) + n
            want = [[i for i in range(len(s) - width + 1) if count[s[i : i + width]] > 1] for s in segments]
            assert [x.tolist() for x in repeated(segments, copies, width)] == want
            assert [x.tolist() for x in repeated(segments, copies, width, memory=0)] == want
            assert [x.tolist() for x in repeated(segments, copies, width, recursive=True)] == want


def test_queues_go_to_disk():
    """A shard whose entries are twenty times what the queues may hold in memory: the peak of their memory stays there."""
    from brindle.llm import induced_sort

    rng = np.random.default_rng(3)
    text = encode([rng.integers(97, 101, 300, dtype=np.uint8).tobytes() for _ in range(500)])
    held, memory = [], 8 * len(text) // 20

    class Watched(induced_sort.Spill):
        def put(self, part):
            out = super().put(part)
            held.append(memory - self.free)
            return out

    plain = np.concatenate([b for b, _ in suffix_order(text, 100)])
    induced_sort.Spill, spill = Watched, induced_sort.Spill
    try:
        assert np.array_equal(np.concatenate([b for b, _ in suffix_order(text, 100, memory)]), plain)
    finally:
        induced_sort.Spill = spill
    assert 0 < max(held) <= memory
