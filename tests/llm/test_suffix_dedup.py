import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import suffix_dedup
from brindle.llm.suffix_dedup import runs, strip_repeats

SCHEMA = "doc_id long, text string, stripped string"


def brute(texts, width=200):
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for i in range(len(d) - width + 1):
            key = hash(d[i : i + width])
            count[key] = count.get(key, 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - width + 1):
            if count[hash(d[i : i + width])] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(d) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(60), prose(3000)
    out = [None, "", "short", "a" * 199, "a" * 200, "b" * 201, "ab" * 3000, "c" * 30000, ("line of a repeated table | 12 |\n") * 100, passage[:200], passage[:201]]
    for _ in range(30):
        out.append(prose(rng.randrange(80)) + passage[rng.randrange(40) : 330 - rng.randrange(90)] + prose(rng.randrange(80)))
    for _ in range(6):
        edited = list(long)
        for _ in range(5):
            edited[rng.randrange(len(edited))] = rng.choice("xyzé")
        out.append("".join(edited))
    out += [prose(300) for _ in range(20)]
    exact = prose(200)
    return out + [exact] * 40 + [exact[50:]]


def test_matches_brute_force(spark, monkeypatch, tmp_path):
    given = texts()
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], SCHEMA).repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = strip_repeats(df)
    assert out.columns == ["doc_id", "text", "stripped", "_stripped"]
    got = {r.doc_id: r["_stripped"] for r in out.collect()}
    for i, want in enumerate(brute(given)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
        data = (given[i] or "").encode()
        gone = {j for s in r.removed for j in range(s.start, s.end)}
        assert bytes(b for j, b in enumerate(data) if j not in gone) == r.kept
    assert strip_repeats(df.limit(0)).count() == 0


def test_hot_hashes_are_split(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(suffix_dedup, "HOT", 3000)  # of the driver, which decides on levels
    given = texts()
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], SCHEMA).repartition(3).write.parquet(str(tmp_path / "t"))
    levels = []
    spread = suffix_dedup._spread
    monkeypatch.setattr(suffix_dedup, "_spread", lambda *a: levels.append(spread(*a)) or levels[-1])
    got = {r.doc_id: r["_stripped"] for r in strip_repeats(spark.read.parquet(str(tmp_path / "t"))).collect()}
    for i, want in enumerate(brute(given)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
    ready, links = levels[0]
    assert len(links) >= 2
    per_key = ready.groupBy("h").agg(F.sum(F.length("segment")).alias("n"), F.countDistinct("id").alias("ids"))
    assert per_key.filter("n > 3000 and ids > 1").count() == 0


@pytest.mark.parametrize("width", [40, 200])
def test_split_holds_each_string_once(width):
    rng = random.Random(8)
    segments = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(width, 3 * width))) for _ in range(5)] + [b"a" * 2 * width, b"ab" * width]
    for segment in segments:
        level = [(0, segment, -1, 0, width)]
        while level:
            below = [(at + more, *rest) for at, *given in level for more, *rest in suffix_dedup.split(*given, width)]
            places = sorted(at + i for at, piece, *_ in below for i in range(len(piece) - width + 1))
            assert places == list(range(len(segment) - width + 1)) if level[0][2] < 0 else len(places) == sum(len(p) - width + 1 for _, p, *_ in level)
            assert all(segment[at : at + len(piece)] == piece for at, piece, *_ in below)
            keys = {}
            for _, piece, _, _, _, key in below:
                for i in range(len(piece) - width + 1):
                    assert keys.setdefault(piece[i : i + width], key) == key
            level = [x[:5] for x in below if x[4] - x[3] > 1]


@pytest.mark.parametrize("width", [40, 200])
def test_equal_strings_share_a_hash(width):
    rng = random.Random(3)
    base = bytes(rng.choice(b"abc") for _ in range(700)) + b"z" * 300 + b"yx" * 200
    parts = [base[rng.randrange(500) : rng.randrange(600, len(base))] for _ in range(8)] + [b"", b"q"]
    buf, off = np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])]
    text, first, strings, h, weight, place = runs(buf, off, width)
    assert ((place < 0) == (weight == 2)).all() and (place[place >= 0] <= width - 24).all() and (place[place >= 0] >= strings[place >= 0] - 1).all()
    where, total = {}, {}
    for t, f, n, x, w in zip(text.tolist(), first.tolist(), strings.tolist(), h.tolist(), weight.tolist(), strict=True):
        total[x] = total.get(x, 0) + w
        for i in range(f, f + n):
            where.setdefault(parts[t][i : i + width], []).append(x)
    assert sum(map(len, where.values())) == sum(max(0, len(p) - width + 1) for p in parts)
    for places in where.values():
        assert len(set(places)) == 1 and (len(places) == 1 or total[places[0]] > 1)


def test_long_text_in_pieces(spark, monkeypatch, tmp_path):
    rng = random.Random(4)
    long = "".join(rng.choice("abcd") for _ in range(3 * 4000))
    given = [long, long[4000 - 150 : 4000 + 150] + "e" * 100, long[1000:1300]]
    monkeypatch.setattr(suffix_dedup, "PIECE", 4000)  # the worker's copy stays as it is: cut here instead
    buf = np.frombuffer(long.encode(), np.uint8)
    seen = set()
    for at in range(0, len(buf), 4000):
        part = buf[at : at + 4000 + 199]
        _, first, strings, *_ = runs(part, np.array([0, len(part)]))
        for f, n in zip((first + at).tolist(), strings.tolist(), strict=True):
            new = set(range(f, f + n))
            assert not new & seen
            seen |= new
    assert seen == set(range(len(buf) - 199))
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], SCHEMA).write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r["_stripped"] for r in strip_repeats(spark.read.parquet(str(tmp_path / "t"))).collect()}
    for i, want in enumerate(brute(given)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def test_query_on_table(spark):
    from brindle.llm.queries import op7_suffix_dedup

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows]), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_suffix_dedup(spark, sf).collect()} == want


def test_columns_of_any_name_and_shuffled_rows(spark):
    from pyspark.sql import functions as F

    passage = "".join(chr(97 + i * i % 23) for i in range(260))
    rows = [(i, f"start {i} " + passage * (i % 3 == 0) + f" end {i}", f"n{i}", "s", "t") for i in range(30)] + [(30, None, "n30", "s", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_number string, spans_of_row string, stripped string").repartition(6, F.rand())
    out = strip_repeats(df)
    assert out.columns == [*df.columns, "_stripped"]
    for r in out.collect():
        assert (r.row_number, r.spans_of_row, r.stripped) == (f"n{r.doc_id}", "s", "t")
        assert r["_stripped"]["n_removed"] >= 260 if r.doc_id % 3 == 0 and r.doc_id < 30 else r["_stripped"]["n_removed"] == 0
    assert strip_repeats(df.limit(0)).count() == 0
