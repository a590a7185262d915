import random

import numpy as np
import xxhash

from brindle.llm import simhash
from brindle.llm.components import components
from brindle.llm.simhash import drop_near, fingerprint, linked, links, masks, near_duplicates

SCHEMA = "doc_id long, text string, fp string, root long"


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7)))
    texts = [None, "", "  \n", "One", "one", "one two three", "ONE two\tthree", "é É", "a b c d", "x" * 50000]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([30, 300, 800]))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [(997 * i % 1000, t, "x", i) for i, t in enumerate(texts)] + [(None, texts[12], "x", 1), (None, "quite alone here now again", "x", 1), (5, texts[20], "y", 1), (5, texts[20], "y", 1)]


def test_fingerprints_and_components(spark):
    given = rows()
    fps = [brute_fp(t) for _, t, *_ in given]
    assert [fingerprint(t) for _, t, *_ in given] == fps
    want = brute_components(fps, [r[0] for r in given])
    got = near_duplicates(spark.createDataFrame(given, SCHEMA).repartition(4)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(str((r[0], f"{f:016x}", c)) for r, f, c in zip(given, fps, want, strict=True))


def test_every_pair_in_the_radius_meets():
    table = masks(4)
    rng = random.Random(1)
    assert len(table) == 31
    for _ in range(20000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
        assert any(not flips & m for m in table)


def test_planted_links(spark, monkeypatch):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:120]:
        for _ in range(3):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute_components(fps, list(range(len(fps))))
    roots = {r.node: r.root for r in components(links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    groups = {}
    for s, w in zip(signed, want, strict=True):
        groups.setdefault(roots.get(s, s), set()).add(w)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_large_buckets_are_split_without_loss(monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 10)
    rng = random.Random(2)
    mask = masks(4)[6]
    free = [b for b in range(64) if not mask >> b & 1]
    fps = sorted({sum(1 << b for b in rng.sample(free, rng.randrange(0, 12))) for _ in range(400)})
    found = linked(np.array(fps, np.uint64), 4, mask)
    pairs = [(int(a), int(b)) for a, many in found for b in many]
    at = {f: i for i, f in enumerate(fps)}
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        label[find(at[a])] = find(at[b])
    want = brute_components(fps, list(range(len(fps))))
    assert len({(find(i), w) for i, w in enumerate(want)}) == len(set(want)) == len({find(i) for i in range(len(fps))})


def test_stage_and_empty(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    left = drop_near(df)
    assert left.columns == df.columns
    got = near_duplicates(df).collect()
    fps = [int(r.fingerprint, 16) for r in got]
    groups = len(set(brute_components(fps, list(range(len(fps))))))
    assert left.count() == groups
    assert near_duplicates(df.limit(0)).count() == 0 and drop_near(df.limit(0)).count() == 0


def test_query_on_table(spark):
    import duckdb

    from brindle.llm.queries import op4_simhash

    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1").fetchall()
    fps = [brute_fp(t) for _, t in rows]
    want = [(d, f"{f:016x}", r) for (d, _), f, r in zip(rows, fps, brute_components(fps, [d for d, _ in rows]), strict=True)]
    assert sorted(tuple(r) for r in op4_simhash(spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id").collect()) == want


def test_stage_with_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    rows = [(i, " ".join(f"w{i % 4}x{j}" for j in range(60)), f"n{i}", "r") for i in range(12)] + [(12, None, "n12", "r"), (13, " ", "n13", "r"), (12, None, "n12", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_number string, root string").repartition(5, F.rand())
    got = drop_near(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [*rows[:4], rows[12]]
    assert drop_near(df.limit(0)).count() == 0


def test_small_tables_are_written_in_few_files(spark, monkeypatch):
    from brindle.llm import components as made

    pairs = [(7 * i, 7 * i + j) for i in range(400) for j in (1, 2, 3)] + [(i, i + 1) for i in range(5000, 5040)]
    tables, put = [], made.stored
    monkeypatch.setattr(made, "stored", lambda df, name: tables.append((name, out := put(df, name))) or out)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {7 * i + j: 7 * i for i in range(400) for j in (1, 2, 3)} | {i: 5000 for i in range(5001, 5041)}
    assert len(tables) > 4 and all(len(df.inputFiles()) <= 12 for name, df in tables if name != "edges")
