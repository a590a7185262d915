"""Operators on rows that tables of the test data don't hold: nulls, empty tables, ties, skew, names that clash."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import entities as E
from brindle.functions import rules as R
from brindle.functions import text as X
from brindle.operators import chunked as T
from brindle.operators import content as K
from brindle.operators import corpus as C
from brindle.operators import dialogue as D
from brindle.operators import metrics as M
from brindle.operators import scoring as S
from brindle.operators import set_pairs as P
from brindle.operators import token_sort as Q
from brindle.sources import host_files as H


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string").withColumn("now", F.lit("2026-06-30 10:00:00").cast("timestamp"))


def test_numbers_of_any_length(spark):
    df = texts(spark, "call 12345678901", "call 99999999999999999999", "in 99999999999 minutes", "in 5 minutes", None, "", "seven", "x7 twenty")
    got = [r[0] for r in df.orderBy("id").select(E.number(F.lower("text"))).collect()]
    assert got == [12345678901, None, 99999999999, 5, None, None, 7, 20]
    got = [r[0] for r in df.orderBy("id").select(E.utc_iso(E.relative(F.lower("text"), F.col("now")))).collect()]
    assert got == [None, None, None, "2026-06-30T10:05+00:00", None, None, None, None]
    assert E.resolved(df, "text", "now").count() == 8


def test_patterns_with_bounds_of_any_length(spark):
    df = texts(spark, "a{2,32}", "a{33}", "a{99999999999999999999}", None)
    assert [r[0] for r in df.orderBy("id").select(R.portability(F.col("text"))).collect()] == [[], ["bound too large"], ["bound too large"], []]


def test_token_key_with_marks(spark):
    df = texts(spark, "Où est mon téléphone", "plain text’s", "Straße", None, "ﬁne")
    got = [r[0] for r in df.orderBy("id").select(X.token_key_unicode(F.col("text"))).collect()]
    assert got == ["ou est mon te le phone", "plain text's", "stra e", None, "fine"]


def test_dates_are_parked(spark):
    says = ["tomorrow", "at 6", "friday", "sunday", "3pm", "at 4", None, "yesterday", "tomorrow at 9", "in 5 minutes"]
    rows = E.parked(texts(spark, *says).withColumn("session", F.lit(1)), "text", "now", "session", "id").orderBy("id").collect()
    got = [(str(r.at_time) if r.filled else None, str(r.parked) if r.parked else None) for r in rows]
    assert got == [
        (None, "2026-07-01"), ("2026-07-01 18:00:00", None), (None, "2026-07-03"), (None, "2026-07-05"), ("2026-07-05 15:00:00", None), ("2026-06-30 16:00:00", None),
        (None, None), (None, None), ("2026-07-01 09:00:00", None), ("2026-06-30 10:05:00", None),
    ]


def test_a_label_with_most_of_the_rows(spark):
    df = spark.range(30_000).withColumn("label", F.when(F.col("id") % 10 > 0, "big").when(F.col("id") % 20 == 0, "small"))
    got = C.ranked(df, "label", 42, "id", weight="id").toPandas()
    assert list(got.columns) == ["id", "label", "rank", "size", "before", "total"] and len(got) == 30_000
    for _, part in got.groupby(got.label.fillna("?")):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(part) + 1)) and set(part["size"]) == {len(part)}
        assert part.before.tolist() == (part.id.cumsum() - part.id).tolist() and set(part.total) == {part.id.sum()}
    again = C.ranked(df.repartition(7, F.rand()), "label", 42, "id").toPandas()
    assert dict(zip(got.id, got["rank"], strict=True)) == dict(zip(again.id, again["rank"], strict=True))
    assert C.ranked(df.limit(0), "label", 42, "id").count() == 0


def test_sums_and_ranks_in_ranges(spark):
    df = spark.createDataFrame([(i, float(i * 7919 % 50), i) for i in range(2000)], "id long, s double, n long")
    got = C.summed(df, ["id"], F.col("n")).orderBy("id").collect()
    assert [r.before for r in got] == [i * (i - 1) // 2 for i in range(2000)]
    ranks = M.average_rank(df, "s").toPandas()
    assert np.allclose(ranks["rank"], ranks.s.rank(method="average"))
    assert C.summed(df.limit(0), ["id"], F.col("n")).count() == 0


def test_roots_of_groups(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, f"{i:064x}") for i in range(500)], "g string, d string")
    one = {r.g: (r.n, r.root) for r in C.rooted(df, "g", "d").collect()}
    two = {r.g: (r.n, r.root) for r in C.rooted(df.repartition(9, F.rand()), "g", "d").collect()}
    assert one == two and {k: n for k, (n, _) in one.items()} == {"a": 333, None: 167}
    other = C.rooted(df.filter("d <> '%064x'" % 7), "g", "d").collect()
    assert {r.g: r.root for r in other}["a"] != one["a"][1] and {r.g: r.root for r in other}[None] == one[None][1]


def test_long_chains_are_connected(spark):
    chain = [(i, i + 1) for i in range(400)] + [(1000, 1001), (5000, 5000)]
    got = {r.node: r.group for r in C.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(401), 0) | {1000: 1000, 1001: 1000, 5000: 5000}


def test_equal_sets_are_one_class(spark):
    base = spark.range(100_000).select("id", F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e")).alias("tokens"))
    other = spark.createDataFrame([(-1, ["a", "b", "c", "d", "e", "f"]), (-2, []), (-3, None), (-4, ["e", "d", "c", "b", "a"]), (-5, ["z"])], "id long, tokens array<string>")
    classes, members = S.set_classes(base.union(other))
    assert {(r.id, r.copies) for r in classes.collect()} == {(-4, 100_001), (-1, 1), (-5, 1)}
    assert members.filter("rep = -4").count() == 100_001 and members.count() == 100_003
    assert [tuple(r) for r in S.prefix_pairs(classes, 0.8).collect()] == [(-4, -1, 5 / 6)]


def test_best_cosine_loses_no_pair(spark):
    rng = np.random.default_rng(3)
    docs = {}
    for d in range(80):
        terms = {f"t{int(t)}": 1.0 + rng.random() for t in rng.zipf(1.4, 12) if t < 400}
        length = math.sqrt(sum(w * w for w in terms.values()))
        docs[d] = {t: w / length for t, w in terms.items()}
    df = spark.createDataFrame([(d, t, w) for d, v in docs.items() for t, w in v.items()], "doc long, term string, w double")
    for least in (0.1, 0.4, 0.8):
        got = {r.doc: r.best for r in S.best_cosine(df.filter("doc < 20"), df.filter("doc >= 20"), least).collect()}
        want = {}
        for a in range(20):
            best = max(sum(w * docs[b].get(t, 0.0) for t, w in docs[a].items()) for b in range(20, 80))
            if best >= least:
                want[a] = best
        assert got == pytest.approx(want)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)).round(3)
    x[250] = x[10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = {r.asked_id: (r.id, r.score) for r in S.nearest(df.filter("id % 20 = 0"), df, "id", "v", size=32).collect()}
    assert sorted(got) == list(range(0, 300, 20))
    for i, (j, score) in got.items():
        all_ = x @ x[i]
        all_[i] = -np.inf
        assert score == pytest.approx(all_.max()) and j == int(np.flatnonzero(np.isclose(all_, all_.max(), rtol=0, atol=1e-12))[0])
    assert S.nearest(df.limit(0), df, "id", "v").count() == 0


def test_whitened_distance(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + y[:, None] * 4
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, c int").repartition(4)
    means, precision = S.whitening(df, "v", "c", 0.1)
    centred = np.vstack([x[y == c] - x[y == c].mean(0) for c in range(3)])
    cov = centred.T @ centred / (400 - 3)
    want = np.linalg.inv(0.9 * cov + 0.1 * np.trace(cov) / 5 * np.eye(5))
    assert np.allclose(precision, want) and np.allclose(means, [x[y == c].mean(0) for c in range(3)])
    got = S.mahalanobis(df, "v", means, precision).orderBy("id").toPandas().distance
    assert np.allclose(got, [min(math.sqrt((v - m) @ want @ (v - m)) for m in means) for v in x])


def test_fits(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 600)
    x = rng.normal(size=(600, 4)) * 0.3 + np.eye(4)[y] * 3
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, c long").repartition(4)
    w, b = S.softmax_regression(df.filter("id < 400"), "v", "c", 3)
    assert ((x[400:] @ w + b).argmax(1) == y[400:]).mean() > 0.98
    centres = S.kmeans(df, "id", "v", "c", 2)
    assert sorted(centres) == [(c, k) for c in range(3) for k in range(2)]
    for c in range(3):
        part, two = x[y == c], np.stack([centres[c, 0], centres[c, 1]])
        at = ((part[:, None] - two[None]) ** 2).sum(2).argmin(1)
        assert np.allclose(two, [part[at == k].mean(0) for k in range(2)])


def test_pieces_and_common_length():
    vocab = {"un", "##aff", "##able", "a", "##b", "aa"}
    assert S.pieces("unaffable", vocab) == ["un", "##aff", "##able"] and S.pieces("aab", vocab) == ["aa", "##b"]
    assert S.pieces("xab", vocab) == ["[UNK]", "[UNK]", "##b"] and S.pieces("", vocab) == []
    rng = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcü ") for _ in range(rng.randrange(40))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert S.common_length(a, b) == table[-1][-1]


def test_nearest_token_sort(spark):
    rng = random.Random(8)
    vocab = ["turn", "turned", "volume", "the", "up", "down", "lights", "light", "on", "radio", "please", "now"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 7)))) for i in range(300)] + [(400, None), (420, ""), (440, "  ")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: (r.nn_id, r.score) for r in S.nearest_token_sort(df.filter("id % 20 = 0"), df, "id", "text", 85.0).collect()}
    key = {i: " ".join(sorted((t or "").lower().split())) for i, t in rows}
    first = {}
    for i, k in sorted(key.items()):
        if k:
            first.setdefault(k, i)
    want = {}
    for i in range(0, 300, 20):
        scores = [(round(200 * S.common_length(key[i], k) / (len(key[i]) + len(k)), 6), -j) for k, j in first.items() if k != key[i]]
        if max(scores)[0] >= 85:
            want[i] = (-max(scores)[1], max(scores)[0])
    assert got == want and want


def test_nearest_token_sort_by_blocks(spark, monkeypatch):
    """Blocks of some texts only, words beyond one machine word, copies, ties: the same as all pairs."""
    monkeypatch.setattr(Q, "TEXTS", 40)
    monkeypatch.setattr(Q, "ASKED", 7)
    rng = random.Random(11)
    rows = []
    for _ in range(25):
        base = [rng.choice("abcdeé 𝄞") for _ in range(rng.choice([8, 61, 63, 64, 126, 200, 450]))]
        for _ in range(20):
            text = list(base)
            for _ in range(rng.randrange(max(2, len(base) // 8))):
                text[rng.randrange(len(text))] = rng.choice(["", "a", "b é", "𝄞"])
            rows.append("".join(text))
    rows = [(i, t) for i, t in enumerate(rows * 2)] + [(2000 + 20 * i, "turn the volume up now") for i in range(60)] + [(3301, "turn the volume up"), (3302, None), (3320, " ")]
    df = spark.createDataFrame(rows, "id long, text string")
    found = S.nearest_token_sort(df.filter("id % 20 = 0"), df, "id", "text", 85.0)
    got = sorted(tuple(r) for r in found.collect())
    key = {i: " ".join(sorted((t or "").lower().split())) for i, t in rows}
    first = {}
    for i, k in sorted(key.items()):
        if k:
            first.setdefault(k, i)
    want = []
    for i, k in sorted(key.items()):
        if i % 20 == 0 and k:
            score, j = max((200 * S.common_length(k, o) / (len(k) + len(o)), -j) for o, j in first.items() if o != k)
            if score >= 85:
                want.append((i, -j, round(score, 6)))
    assert got == want and len(want) > 70
    block = Q.Block([1, 2, 3], ["abc", "abcd", "abce"])
    assert block.best("abcd", 70.0) == (1, 600 / 7) and block.best("zzzz", 70.0) is None


def test_band_loses_no_ratio():
    rng = random.Random(12)
    for size in (30, 63, 64, 130, 400):
        base = "".join(rng.choice("abcdeé 𝄞") for _ in range(size))
        some = {base[: (at := rng.randrange(size))] + "x" * rng.randrange(size // 5) + base[at + rng.randrange(size // 5) :] for _ in range(60)}
        texts = sorted(some, key=len)
        block = Q.Block(list(range(len(texts))), texts)
        for text in [base, *texts[::10]]:
            for least in (70.0, 85.0, 92.0):
                scores = [(200.0 * S.common_length(text, t) / (len(text) + len(t)), -i) for i, t in enumerate(texts) if t != text]
                top = max(scores)
                assert block.best(text, least) == ((-top[1], top[0]) if top[0] >= least else None)


def test_replay_equals_the_steps(spark):
    rng = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 30)):
            rows.append((c, t, rng.choice(["ask_mute", "slot_remind", "volume_up", "repeat", None]), rng.choice([0.2, 0.5, 0.7, 0.95, None]), rng.choice(["yes", "no", "value", "cancel", None, None])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, intent string, conf double, answer string")
    got = {(r.conv_id, r.turn): tuple(r)[2:] for r in D.replay(df).collect()}
    assert len(got) == len(rows)
    for c in range(60):
        state = D.fresh()
        for r in sorted(x for x in ((r[1], r) for r in rows if r[0] == c)):
            _, turn, intent, conf, answer = r[1]
            state, kind, said = D.step(state, intent, conf or 0.0, answer)
            assert got[c, turn] == (kind, said, state["pending"], state["slot"], state["attempts"], state["last"], state["lifespan"])
    assert D.replay(df.limit(0)).count() == 0


def test_newest_fact_across_buckets(spark):
    rng = random.Random(10)
    facts = [(rng.choice("abc"), i * 3, rng.choice([True, False, None])) for i in range(200)]
    asked = [(i, rng.choice("abcd"), rng.randrange(-5, 700)) for i in range(300)]
    got = D.newest(spark.createDataFrame(asked, "id long, k string, at long"), spark.createDataFrame(facts, "k string, since long, v boolean"), "k", "at", "since", "v", span=16)
    want = {i: next((v for fk, s, v in reversed(facts) if fk == k and s <= at and v is not None), None) for i, k, at in asked}
    assert got.columns == ["id", "k", "at", "v"] and {r.id: r.v for r in got.collect()} == want


def test_workbooks_bundles_and_capabilities(spark, tmp_path):
    H.write_bytes(spark, f"file://{tmp_path}/b/x.xlsx", H.workbook({"Tom & \"Co\"": ["a < b", " ", "ü\nline"], "two": []}))
    assert [tuple(r) for r in H.read_workbooks(spark, f"file://{tmp_path}/b").collect()] == [("a < b", 'Tom & "Co"', 1), ("ü\nline", 'Tom & "Co"', 3)]
    H.write_bytes(spark, f"file://{tmp_path}/z/x.zip", H.bundle({"a.txt": b"1", "d/b.txt": b""}, brand="x"))
    assert {(r.name, r.issue) for r in H.read_bundles(spark, f"file://{tmp_path}/z").collect()} == {("a.txt", "ok"), ("d/b.txt", "ok")}
    (tmp_path / "c").mkdir()
    (tmp_path / "c/all.yaml").write_text("---\nintent: a.b\ncapability: a\nfollowup: true\n---\n---\nintent: c\nslots:\n- name: x\n  entity: y\n")
    rows = H.read_capabilities(spark, f"file://{tmp_path}/c").collect()
    assert [(r.intent, r.capability, r.followup, [(s.name, s.entity, s.required) for s in r.slots]) for r in rows] == [("a.b", "a", True, []), ("c", None, False, [("x", "y", False)])]


def test_content_checks_on_odd_catalogues(spark):
    kind = "intent string, capability string, action string, followup boolean"
    intents = spark.createDataFrame([("a", "c", "x", True), ("a", "c", "x", True), (None, None, None, None)], kind)
    slots = spark.createDataFrame([("a", "s", "e"), ("a", "t", None)], "intent string, slot string, entity string")
    none = spark.createDataFrame([], "entity string")
    assert {r.what for r in K.missing(slots, none, "entity", "V3", "intent").collect()} == {"e", None}
    assert K.policy_verdicts(intents, spark.createDataFrame([("a", "never")], "intent string, confirm string")).count() == 3
    assert K.references(intents.limit(0), slots.limit(0), spark.createDataFrame([], "intent string, kind string, terms array<string>"), none, spark.createDataFrame([], "action string"), spark.createDataFrame([], "capability string")).count() == 0
    found = spark.createDataFrame([("p", 1, "warning"), ("p", 2, "error"), ("p", 2, "warning"), ("p", 3, "error"), ("q", 9, "warning")], "pack string, stage int, severity string")
    assert sorted(map(tuple, K.until_first_error(found, "pack").collect())) == [("p", 1, "warning"), ("p", 2, "error"), ("p", 2, "warning"), ("q", 9, "warning")]


def test_small_operators_on_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, "", "x"), (5, "b", None)], "id long, key string, label string")
    assert {r["id"] for r in C.first_per_key(df, "key", "id").collect()} == {1, 3, 4, 5}
    assert {r["id"] for r in C.leaks(df, df.select("key"), "key", "id").collect()} == {1, 5}
    assert {r.key for r in C.conflicting_keys(df, "key", "label").collect()} == {"a"}
    assert {r.label: r.n for r in C.class_weights(df, "label").collect()} == {"x": 3, "y": 1, None: 1}
    top = C.top_per_label(df, "label", F.lit(0), 1, "id")
    assert top.columns == df.columns and {r["id"] for r in top.collect()} == {1, 2, 5}
    assert C.oversampled(df, F.col("label") == "x", 3).count() == 3 * 3 + 2
    for out in (C.first_per_key(df.limit(0), "key", "id"), C.class_weights(df.limit(0), "label"), C.connected(spark.createDataFrame([], "a long, b long")), M.per_label(df.limit(0), "key", "label")):
        assert out.count() == 0


def _tfidf_joined(rows):
    counts = S.term_counts(rows.select("doc_id", F.explode(X.ngrams(F.col("text"))).alias("term")), "doc_id", "term")
    return S.tfidf_vectors(counts, S.tfidf_fit(counts))


@pytest.fixture()
def chunked_rows(spark):
    """Odd texts in chunks of a few rows, so that every word and pair is in several."""
    texts = ["aa bb cc dd", "aa bb", None, "", "x", "bb aa bb aa bb", "dd cc bb aa", "été aa bb", "aa_1 aa_1", "zz yy aa_1 aa_1"] * 3
    rows = spark.createDataFrame([(i, t, "pq"[i % 2] if i % 7 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(8)
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return rows, lambda **marks: T.TfIdf(T.chunks(rows, "doc_id", words, **marks))


def test_chunked_tfidf_is_the_joined_one(chunked_rows):
    rows, model = chunked_rows
    assert model().chunked.count() > 3
    got = {(r.doc, r.term): r.w for r in model().vectors().collect()}
    want = {(r.doc, r.term): r.w for r in _tfidf_joined(rows).collect()}
    assert got == pytest.approx(want)


def test_chunked_logits_are_the_joined_ones(spark, chunked_rows):
    rows, model = chunked_rows
    bias = [("p", 0.5), ("q", 0.0), ("never", 1.0)]
    v = _tfidf_joined(rows)
    coef = v.join(rows.select(F.col("doc_id").alias("doc"), F.col("lang").alias("label")), "doc").groupBy("term", "label").agg(F.avg("w").alias("coef"))
    want = S.linear_logits(rows.select(F.col("doc_id").alias("doc")), v, coef, spark.createDataFrame(bias, "label string, b double"))
    got = model(label=F.col("lang"), labels=[name for name, _ in bias]).label_logits(bias)
    assert {(r.doc, r.label): r.z for r in got.collect()} == pytest.approx({(r.doc, r.label): r.z for r in want.collect()})


@pytest.mark.parametrize(("dense", "least"), [(1, 0.1), (2, 0.6), (1024, 0.1)])
def test_chunked_best_cosine_is_that_of_all_pairs(chunked_rows, dense, least):
    rows, model = chunked_rows
    v = {}
    for r in _tfidf_joined(rows).collect():
        v.setdefault(r.doc, {})[r.term] = r.w
    lang = {r.doc_id: r.lang for r in rows.collect()}
    want = {}
    for a in v:
        if lang[a] == "p":
            top = max(sum(w * v[b].get(t, 0.0) for t, w in v[a].items()) for b in v if lang[b] == "q")
            want[a] = top if top >= least else -1
    got = model(kind=F.col("lang")).best_cosine("p", "q", least, dense)
    assert {r.doc: -1 if r.best is None else r.best for r in got.collect()} == pytest.approx(want)


def test_stored_table_is_small_and_the_same(spark):
    rows = spark.range(1000).withColumn("t", F.lit("x" * 100))
    kept = C.stored(rows.repartition(2))
    assert kept.dtypes == rows.dtypes and kept.count() == 1000
    assert sum(os.path.getsize(f.removeprefix("file:")) for f in kept.inputFiles()) < 20_000


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_similar_pairs_are_all_pairs(spark, threshold):
    rng = random.Random(1)
    base = [[f"t{int(rng.paretovariate(0.5)) % 300}" for _ in range(rng.randint(1, 60))] for _ in range(40)]
    sets = [sorted(set(rng.choice(base)) - {f"t{rng.randint(0, 9)}"} | {f"t{rng.randint(0, 40)}"}) for _ in range(300)] + [[], ["one"], ["one"]]
    rows = spark.createDataFrame([(i, s, "pq"[i % 2] if i % 9 else None) for i, s in enumerate(sets)], "id long, tokens array<string>, g string")
    for block in (None, "g"):
        classes, members = P.classes_by_digest(rows, block)
        first, want = {}, {}
        for i, s in enumerate(sets):
            if s:
                first.setdefault((tuple(s), block and ("pq"[i % 2] if i % 9 else None)), i)
        for (s, g), a in first.items():
            for (t, h), b in first.items():
                sim = len({*s} & {*t}) / len({*s} | {*t})
                if a < b and g == h and (g is not None or not block) and sim >= threshold:
                    want[a, b] = sim
        found = P.similar_pairs(rows, classes, threshold, block).collect()
        assert len(found) == len(want) > 20 and {(r.a, r.b): r.sim for r in found} == pytest.approx(want)
        assert {r.id: r.rep for r in members.collect()} == {i: first[tuple(s), block and ("pq"[i % 2] if i % 9 else None)] for i, s in enumerate(sets) if s}
