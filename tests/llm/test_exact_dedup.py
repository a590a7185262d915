import hashlib
import re

from pyspark.sql import functions as F

from brindle.llm.exact_dedup import drop_exact, exact_duplicates, identities

SCHEMA = "doc_id long, text string, kept string, row long, name string"


def rows():
    long = " ".join(str(i) for i in range(30000))
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\tb ", "a b ", long, long.replace(" 29999", "\n29999"), long + "x", long[:2048], long[:2049], long[:4096], "é" * 5000, "é" * 5000, "a b"] + ["copy copy " * 300] * 90 + ["other " * 900] * 70
    made = [(i * 7 % 1009, t, "k", i, None) for i, t in enumerate(texts)]
    return made + made[4:8] + [(None, "a b", None, 1, "n"), (None, "alone", None, 1, "n"), (None, "alone", None, 1, "n")]


def brute(given):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in given]
    groups = {}
    for (doc, *_), n in zip(given, norm, strict=True):
        groups.setdefault(n, []).append(doc)
    out = []
    for (doc, *_), n in zip(given, norm, strict=True):
        ids = [d for d in groups[n] if d is not None]
        out.append((doc, min(ids) if ids else None, len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return out


def key(r):
    return [(v is None, v or 0) if not isinstance(v, str) else v for v in r]


def test_matches_brute_force(spark):
    given = rows()
    df = spark.createDataFrame(given, SCHEMA).repartition(5)
    got = exact_duplicates(df).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(brute(given), key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_stage_and_empty(spark, tmp_path):
    given = rows()
    spark.createDataFrame(given, SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    left = drop_exact(df)
    assert left.columns == df.columns
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in left.collect()]
    assert len(norm) == len(set(norm)) == len({b[3] for b in brute(given)})
    assert exact_duplicates(df.limit(0)).count() == 0 and drop_exact(df.limit(0)).count() == 0


def test_names_are_told_apart_where_hashes_are_not(spark):
    given = [r for r in rows() if len(r[1] or "") < 4000]
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    for weak in (lambda b: F.lit(1).cast("long"), lambda b: F.pmod(F.xxhash64(b), F.lit(5))):
        got = identities(df, block=16, hashed=weak).collect()
        by_name, by_text = {}, {}
        for r in got:
            by_name.setdefault((r.level, r.name), set()).add(bytes(r.sha))
            by_text.setdefault(bytes(r.sha), set()).add((r.level, r.name))
        assert len(got) == len(given)
        assert all(len(x) == 1 for x in [*by_name.values(), *by_text.values()])


def test_stage_numbers_rows_once(spark):
    df = spark.createDataFrame([(i, f"text {i % 100}", "k", i, None) for i in range(1000)], SCHEMA)
    df = df.withColumn("row_number", F.lit("kept")).repartition(7, F.rand())
    left = drop_exact(df)
    assert left.columns == df.columns and left.count() == 100 and {r.doc_id for r in left.collect()} == set(range(100))
