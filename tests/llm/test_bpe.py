import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm.bpe import Bpe, _parsed, decoded, encoded, load

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rng = random.Random(4)
    out = ["", " ", "a", "  two  spaces\n\n tab\t", "don't we'll I'm O'S", "<|endoftext|>", "x <|endoftext|><|endoftext|> y<|endof", "a" * 3000, "ab" * 2000, "=" * 999, "é" * 500, "日本語のテキスト 123 ４５", "👍🏽 emoji ✓", "\x00\x01\x1c\x85  　 x", "".join(chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000), "w" + "qz" * 30000]
    alphabet = "abcdefgé ñ\n '.,12 "
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(300)]
    out += [" ".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(300)) for _ in range(20)]
    return out


def test_encodes_and_decodes_like_the_library(theirs):
    bpe = _parsed(load(PATH))
    given = texts()
    want = [e.ids for e in theirs.encode_batch(given, add_special_tokens=False)]
    flat, offsets = bpe.encode(given)
    for i, (text, ids, joined, back) in enumerate(zip(given, want, bpe.joined(flat, offsets), bpe.decode(flat, offsets), strict=True)):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == ids, text[:80]
        assert joined == ",".join(map(str, ids))
        assert back == theirs.decode(ids, skip_special_tokens=False) == text


def test_long_words_merged_alone(theirs):
    bpe, rng = _parsed(load(PATH)), random.Random(6)
    for word in ["aaaa", "ab" * 999, "".join(rng.choice("abcdeé日") for _ in range(5000)), "=" * 777, "the" * 1500, "z"]:
        want = theirs.encode(word, add_special_tokens=False).ids
        assert bpe.merged_alone(word.encode()).tolist() == want
        flat, start, size = bpe.merged([word.encode(), b"x"])
        assert flat[start[0] : start[0] + size[0]].tolist() == want


def test_a_very_long_word_takes_no_rounds_of_its_own(theirs):
    import time

    word = "".join(random.Random(7).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    began = time.perf_counter()
    ids, _ = _parsed(load(PATH)).encode([word])
    assert time.perf_counter() - began < 30 and ids.tolist() == theirs.encode(word, add_special_tokens=False).ids


def test_decodes_any_ids(theirs):
    bpe = _parsed(load(PATH))
    rng = random.Random(8)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert bpe.decode(np.array(ids, np.int64), np.array([0, len(ids)])) == [theirs.decode(ids, skip_special_tokens=False)]


def test_small_memory_gives_the_same(theirs, monkeypatch):
    from brindle.llm import bpe as module

    monkeypatch.setattr(module, "REMEMBERED", 50)
    monkeypatch.setattr(module, "ROUND_BYTES", 64)
    import json

    mine = Bpe(json.loads(load(PATH)))
    given = texts()[:100]
    for _ in range(2):
        ids, offsets = mine.encode(given)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in theirs.encode_batch(given, add_special_tokens=False)]


def test_operator_on_rows(spark, theirs):
    given = [(i, t, "x", None) for i, t in enumerate([*texts(), None, "a", "a"])]
    df = spark.createDataFrame(given, "doc_id long, text string, bpe string, ids string").repartition(3)
    out = encoded(df, PATH)
    assert out.columns == ["doc_id", "text", "bpe", "ids", "_bpe"]
    for r in out.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert r["_bpe"]["ids"] == ids and r["_bpe"]["n_tokens"] == len(ids)
        assert r["_bpe"]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["_bpe"]["decoded_sha256"] == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = decoded(out.select("text", "_bpe.ids"), PATH)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert encoded(df.limit(0), PATH).count() == 0


def test_query_on_table(spark, theirs):
    import duckdb

    from brindle.llm.queries import op9_bpe

    rows = duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY 1").fetchall()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = [e.ids for e in theirs.encode_batch([t for _, t in rows], add_special_tokens=False)]
    want = [(d, len(i), sha(",".join(map(str, i))), sha(theirs.decode(i, skip_special_tokens=False))) for (d, _), i in zip(rows, ids, strict=True)]
    assert [tuple(r) for r in op9_bpe(spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()] == want
