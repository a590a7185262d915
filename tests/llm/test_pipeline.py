import hashlib
import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_mixing import expected_targets
from tests.llm.test_near_copies import brute as near_brute
from tests.llm.test_quality import brute as judged


def brute(docs):
    docs = [d for d in docs if judged(d["text"])["kept"]]
    first = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d["text"]), d)
    docs = list(first.values())
    stay = set(near_brute([(d["doc_id"], d["text"]) for d in docs]))
    docs = [d for d in docs if d["doc_id"] in stay]
    size = {d["doc_id"]: len(d["text"].split()) for d in docs}
    per_source = Counter()
    for d in docs:
        per_source[d["source"]] += size[d["doc_id"]]
    target, passes, start = expected_targets(dict(per_source)), Counter(), Counter()
    for d in sorted(docs, key=lambda d: hashlib.md5(str(d["doc_id"]).encode()).hexdigest()):
        s, n = d["source"], size[d["doc_id"]]
        passes[d["doc_id"]] = sum(n > 0 and start[s] + k * per_source[s] < int(target[s] + 0.5) for k in range(2))
        start[s] += n
    bpe = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    out = []
    for d in docs:
        ids = bpe.encode(d["text"], add_special_tokens=False).ids
        row = (d["doc_id"], d["source"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest(), ids)
        out += [row] * passes[d["doc_id"]]
    return sorted(out)


def test_run_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == brute(docs)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_number string, position string, quality string, bpe string"


def test_stages_on_odd_rows(spark):
    """Nulls, blanks, repeated rows, a very long text and columns named like the stages' own."""
    long, clean = " ".join(f"w{i}" for i in range(60_000)), " ".join(map(str, range(99)))
    rows = [(1, None, None, None, None), (None, clean, "x", None, 1), (2, " \n", "x", "a", 1), (3, long, "x", "a", 1), (3, long, "x", "a", 1), (4, long + " end", "y", "b", None), (5, clean, "x", "b", 1)]
    docs = spark.createDataFrame([(*r, f"n{r[0]}", "p", "q", None) for r in rows], SCHEMA).repartition(3)
    want = {"quality_rules": [3, 3, 4, 5, None], "exact_dedup": [1, 2, 3, 4, 5], "simhash_near_dedup": [1, 3, 5]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        kept = out.collect()
        assert all(r.row_number == f"n{r.doc_id}" and (r.position, r.quality, r.bpe) == ("p", "q", None) for r in kept)
        if name in want:
            assert sorted((r.doc_id for r in kept), key=lambda d: (d is None, d)) == want[name], name
        assert stage(spark, docs.limit(0), "").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert out.count() == len(rows) and {r.n_tokens for r in out.collect() if r.doc_id == 1} == {0}


def test_tables_on_the_way_are_deleted(spark):
    import glob

    from brindle.llm import scratch

    before = set(glob.glob(f"{scratch.folder(spark)}/*"))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(glob.glob(f"{scratch.folder(spark)}/*")) - before
    assert len(left) == 1 and left == {p for p in corpus_pipeline.STORED.paths if p in left} and out.count() > 0


def test_a_stage_keeps_what_its_input_reads(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lazy = corpus_pipeline.exact_duplicates(spark, docs, "")
    kept = corpus_pipeline.quality_rules(spark, lazy, "")
    assert 0 < kept.count() < lazy.count()


def test_stages_write_small_tables_in_few_files(spark, monkeypatch):
    from brindle.llm import components, exact_dedup, mixing, near_copies

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(150)]
    rows = [(i, t + " end" * (i // 150 % 2), "en", "ab"[i % 2], 0) for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(4)
    tables = []
    for module in (exact_dedup, near_copies, mixing, components):
        monkeypatch.setattr(module, "stored", lambda df, name, put=module.stored: tables.append((name, out := put(df, name), len(out.inputFiles()))) or out)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = exact_dedup.drop_exact(docs)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(300))
        assert sorted(r.doc_id for r in near_copies.drop_similar(docs).collect()) == list(range(150))
        assert {r.doc_id for r in mixing.mixed(docs).collect()} <= set(range(450))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(tables) > 20 and not [(name, files) for name, _, files in tables if files > 12]
