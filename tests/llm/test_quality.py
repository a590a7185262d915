import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.llm.quality import Rules, keep_good, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)

    def inside(width, later):
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        count, seen, cover = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if (g in seen) if later else count[g] > 1:
                cover.update(range(i, i + width))
            seen.add(g)
        return cover

    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(inside(3, False)), "dup_line_chars": dup_chars}
    for n in Rules().max_dup_ngram_share:
        out[f"dup_{n}gram_chars"] = sum(len(words[i]) for i in inside(n, True))
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    out["kept"] = not (out["base_failed"] or dup_chars > 0.2 * out["word_chars"] or any(out[f"dup_{n}gram_chars"] > most * out["word_chars"] for n, most in Rules().max_dup_ngram_share.items()))
    return out


def texts():
    rng = random.Random(5)
    vocabulary = ["a", "bb", "ü", "日本", "x#y", "<p>", "tail.", " nb", "zz" * 40]
    made = [None, "", " ", "\n\n", "\n", "one", "a\n a\na\na", "a b c a b c\n", "é " * 300, "w" * 70000, "\t".join(str(i) for i in range(60)), " ".join(str(i) for i in range(400000 // 6))]
    for _ in range(200):
        made.append("".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(rng.choice([3, 60, 300]))))
    made += [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) for _ in range(50)]
    return made + made[:20]


def test_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.quality.asDict() for r in quality(df).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert any(x["kept"] for x in got.values())


def thue_morse(n, flip):
    return "".join("ab"[(i.bit_count() & 1) ^ flip] for i in range(n))


def test_different_spans_with_like_hashes(spark, monkeypatch):
    """Thue-Morse words collide under any polynomial modulo 2^64; and all spans do if the hash is constant."""
    rows = [(n, f"{thue_morse(n, 0)}\n{thue_morse(n, 1)}") for n in (1024, 2048, 4096, 8192)]
    got = quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.quality.n_dup_lines for r in got] == [0] * 4
    import numpy as np
    import pyarrow as pa

    from brindle.llm import quality as module
    from brindle.llm.arrow_text import pieces

    monkeypatch.setattr(module._Roll, "spans", lambda self, start, end: np.zeros(len(start), np.uint64))
    given = [t for t in texts() if len(t or "") < 2000]
    for lo, hi, buf, off in pieces(pa.array(given, pa.string()), 20_000):
        figures = module.measure(buf, off, Rules())
        for i in range(lo, hi):
            assert {k: v[i - lo] for k, v in figures.items()} == brute(given[i])


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "x " * 10, "q", True), (2, " ".join(map(str, range(80))), "r", None)], "doc_id long, text string, quality string, kept boolean")
    assert quality(df).columns == ["doc_id", "text", "quality", "kept", "_quality"]
    assert [tuple(r) for r in keep_good(df).collect()] == [(2, " ".join(map(str, range(80))), "r", None)]
    assert quality(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_table(spark, sf):
    from brindle.llm.queries import op1_quality_rules

    got = {r.doc_id: r.asDict() for r in op1_quality_rules(spark, f"/root/testdata/{sf}").collect()}
    for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect():
        row = got[r.doc_id]
        assert {k: v for k, v in row.items() if k != "doc_id"} == brute(r.text)
