import random
import re

import duckdb

import corpus_pipeline
from brindle.llm import near_copies
from brindle.llm.near_copies import drop_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs):
    """doc_ids that stay of (doc_id, text)."""
    sets, label = [shingle_set(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if min(len(a), len(sets[j])) * 5 >= 4 * max(len(a), len(sets[j])) and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def planted():
    """Chains of copies on both sides of the similarity, and texts that share a common passage."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    passage, texts = [word() for _ in range(60)], [None, "", " \n", "One two", "one TWO", "one two three four five six"]
    for size in [50, 90, 300, 300, 700] * 6:
        text = [word() for _ in range(size)]
        for _ in range(6):
            texts.append(" ".join(text if rng.random() < 0.5 else [*text, *passage]))
            text = list(text)
            for _ in range(max(1, size // rng.choice([40, 46, 50, 60]))):
                text[rng.randrange(size)] = word()
    return [(i * 613 % 997, t) for i, t in enumerate(texts)]


def test_planted_copies_match_brute_force(spark, tmp_path):
    given = planted()
    spark.createDataFrame([(d, t, "x", "y", 1) for d, t in given], SCHEMA).repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    left = drop_similar(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == brute(given)
    assert drop_similar(df.limit(0)).count() == 0


def test_stage_finds_all_similar_pairs_of_the_table(spark, tmp_path):
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    first = {}
    for d, t in sorted(docs):
        if len((t or "").split()) >= 50:
            first.setdefault(re.sub(r"\s+", " ", t), d)
    given = [(d, t) for t, d in first.items()]
    spark.createDataFrame([(d, t, "x", "y", 1) for d, t in given], SCHEMA).write.parquet(str(tmp_path / "t"))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    left = sorted(r.doc_id for r in stage(spark, spark.read.parquet(str(tmp_path / "t")), "").collect())
    assert left == brute(given) and len(left) < len(given)


def test_fingerprints_link_what_is_within_the_radius():
    from brindle.llm import simhash

    for text in (None, "", "a b", "one two three four five six seven", "x " * 50 + "end"):
        found = near_copies.shingles(text)
        bits = [sum(int(h) >> i & 1 for h in found) * 2 > len(found) for i in range(64)]
        assert near_copies.fingerprint(found) == sum(1 << i for i, b in enumerate(bits) if b)
    words = [f"w{i}" for i in range(300)]
    assert near_copies.fingerprint(near_copies.shingles(" ".join(words))) == simhash.fingerprint(" ".join(words), near_copies.WIDTH)


def test_columns_of_any_name(spark):
    rows = [(i, " ".join(f"w{i % 3}x{j}" for j in range(40)), f"n{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_number string")
    got = drop_similar(df.repartition(4))
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == rows[:3]
    assert drop_similar(df.limit(0)).count() == 0
