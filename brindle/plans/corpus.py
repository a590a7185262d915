"""Queries over corpora: keys, leakage, dedup, splits, profiles. ``source`` plays the label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import corpus as C
from brindle.plans import oracle as O
from brindle.plans.catalog import query
from brindle.sources.tables import aliased, table

#: Sources that are held out for evaluation; all others are for training.
HELD_OUT = ("src1", "src2", "src3")
_IN = "(" + ", ".join(f"'{s}'" for s in HELD_OUT) + ")"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _key_query(name: str, make, sql) -> None:
    @query(f"SELECT doc_id, {sql('text')} AS key FROM documents", name=name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return docs(spark, sf).select("doc_id", make(F.col("text")).alias("key"))


for _name, _make, _sql in (
    ("norm_feat", X.feature_key, O.feature_key), ("norm_leak", X.leak_key, O.leak_key), ("norm_norm", X.norm_key, O.norm_key), ("norm_group_key", X.group_key, O.group_key),
    ("norm_tok_key", X.token_key, O.token_key), ("norm_fold", X.fold_key, O.fold_key), ("norm_core", X.core_key, O.core_key), ("norm_ascii", X.ascii_key, O.ascii_key),
    ("norm_loose", X.loose_key, O.loose_key), ("norm_token_set", X.token_set, O.token_set), ("truncate_input", X.truncated, lambda c: f"substring(trim({c}, ' '), 1, 500)"),
):
    _key_query(_name, _make, _sql)


@query()
def norm_leak_unicode(spark, sf):
    return docs(spark, sf).select("doc_id", X.leak_key_unicode(F.col("text")).alias("key"))


@query()
def norm_tok_key_unicode(spark, sf):
    return docs(spark, sf).select("doc_id", X.token_key_unicode(F.col("text")).alias("key"))


@query("SELECT text, source AS intent, doc_id FROM documents")
def scan_alias_cols(spark, sf):
    return aliased(docs(spark, sf).select("doc_id", F.col("text").alias("Utterance"), F.col("source").alias("Category"))).select("text", "intent", "doc_id")


@query("SELECT doc_id, source FROM documents WHERE length(trim(text, ' ')) > 0 AND length(trim(source, ' ')) > 0")
def filter_nonempty(spark, sf):
    return docs(spark, sf).filter((F.length(F.trim("text")) > 0) & (F.length(F.trim("source")) > 0)).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def filter_valid_labels(spark, sf):
    valid = spark.createDataFrame([("en",), ("fr",)], "lang string")
    return docs(spark, sf).select("doc_id", "lang").join(F.broadcast(valid), "lang", "left_semi")


@query(f"SELECT doc_id, len({O.words('text')})::BIGINT AS n FROM documents WHERE len({O.words('text')}) >= 4")
def filter_min_words(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n")).filter("n >= 4")


def keyed(spark: SparkSession, sf: str, key: Column | None = None) -> DataFrame:
    return docs(spark, sf).select("doc_id", "source", "lang", (X.leak_key(F.col("text")) if key is None else key).alias("key"))


def digested(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, lang, key) with a digest of the key, stored: texts are read once, and joins move 64 bytes a row."""
    return C.checkpointed(keyed(spark, sf, F.sha2(X.leak_key(F.col("text")), 256)))


_DIGESTED = f"k AS (SELECT doc_id, source, lang, sha256({O.leak_key('text')}) AS key FROM documents)"
_KEYED = f"k AS (SELECT doc_id, source, lang, {O.leak_key('text')} AS key FROM documents)"
_ROLES = f"{_KEYED}, train AS (SELECT * FROM k WHERE source NOT IN {_IN}), held AS (SELECT * FROM k WHERE source IN {_IN})"


def roles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = keyed(spark, sf)
    held = F.col("source").isin(*HELD_OUT)
    return k.filter(~held), k.filter(held)


@query(f"WITH {_ROLES} SELECT key, min(doc_id) AS doc_id FROM train WHERE key <> '' AND key IN (SELECT key FROM held) GROUP BY key")
def leak_find(spark, sf):
    return C.leaking(keyed(spark, sf), F.col("source").isin(*HELD_OUT), "key", "doc_id")


@query(f"WITH {_ROLES} SELECT doc_id, source FROM train WHERE key NOT IN (SELECT key FROM held)")
def leak_mask(spark, sf):
    train, held = roles(spark, sf)
    return C.without_leaks(train, held, "key").select("doc_id", "source")


@query(f"WITH {_ROLES} SELECT count(*)::BIGINT AS overlap, count(*) = 0 AS clean FROM (SELECT key FROM train INTERSECT SELECT key FROM held)")
def leak_assert(spark, sf):
    train, held = roles(spark, sf)
    return train.select("key").intersect(held.select("key")).agg(F.count("*").alias("overlap"), (F.count("*") == 0).alias("clean"))


@query(f"WITH {_ROLES}, a AS (SELECT t.doc_id, min(h.source) AS set_name FROM train t JOIN held h USING (key) GROUP BY t.doc_id) SELECT set_name, count(*)::BIGINT AS n FROM a GROUP BY set_name")
def leak_attrib(spark, sf):
    train, held = roles(spark, sf)
    by_key = held.groupBy("key").agg(F.min("source").alias("set_name"))
    return train.join(by_key, "key").groupBy("set_name").agg(F.count("*").alias("n"))


@query(f"WITH {_ROLES} SELECT doc_id, source FROM held WHERE key NOT IN (SELECT key FROM train)")
def leak_protect_training(spark, sf):
    train, held = roles(spark, sf)
    return C.without_leaks(held, train, "key").select("doc_id", "source")


@query(f"WITH {_ROLES}, h AS (SELECT DISTINCT key FROM held), s AS (SELECT count(*)::BIGINT AS n_keys, count(*) FILTER (key IN (SELECT key FROM train))::BIGINT AS n_seen FROM h) SELECT *, round(n_seen / n_keys, 6) AS share, n_seen / n_keys > 0.2 AS flagged FROM s")
def leak_overlap_share(spark, sf):
    train, held = roles(spark, sf)
    seen = train.select("key").distinct().withColumn("seen", F.lit(True))
    s = held.select("key").distinct().join(seen, "key", "left").agg(F.count("*").alias("n_keys"), F.count("seen").alias("n_seen"))
    share = F.col("n_seen") / F.col("n_keys")
    return s.select("n_keys", "n_seen", F.round(share, 6).alias("share"), (share > 0.2).alias("flagged"))


@query(f"""WITH k AS (SELECT doc_id, source, {O.norm_key('text')} AS norm, {O.group_key('text')} AS grp FROM documents), h AS (SELECT * FROM k WHERE source IN {_IN}),
t AS (SELECT * FROM k WHERE source NOT IN {_IN} AND norm NOT IN (SELECT norm FROM h) AND grp NOT IN (SELECT grp FROM h)) SELECT min(doc_id) AS doc_id FROM t GROUP BY norm""")
def leak_two_key_forbid(spark, sf):
    k = docs(spark, sf).select("doc_id", "source", X.norm_key(F.col("text")).alias("norm"), X.group_key(F.col("text")).alias("grp"))
    held = F.col("source").isin(*HELD_OUT)
    forbidden = k.filter(held)
    left = C.without_leaks(C.without_leaks(k.filter(~held), forbidden, "norm"), forbidden, "grp")
    return left.groupBy("norm").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"WITH {_ROLES}, c AS (SELECT doc_id, regexp_replace(key, '[a-z]$', '') AS key FROM train) SELECT doc_id FROM c WHERE key NOT IN (SELECT key FROM train)")
def collide_after_corrupt(spark, sf):
    train, _ = roles(spark, sf)
    cut = train.select("doc_id", F.regexp_replace("key", "[a-z]$", "").alias("key"))
    return C.without_leaks(cut, train, "key").select("doc_id")


@query(f"""WITH {_KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source DESC, doc_id DESC) AS n, count(DISTINCT source) OVER (PARTITION BY key) AS labels, min(doc_id) OVER (PARTITION BY key) AS first_id FROM k)
SELECT first_id, source, labels > 1 AS conflict FROM r WHERE n = 1""")
def merge_keyed_last_wins(spark, sf):
    last = F.max(F.struct("source", "doc_id"))
    return keyed(spark, sf).groupBy("key").agg(F.min("doc_id").alias("first_id"), last["source"].alias("source"), (F.min("source") != F.max("source")).alias("conflict")).drop("key")


@query(f"WITH {_ROLES}, u AS (SELECT * FROM train UNION ALL SELECT * FROM held) SELECT min(doc_id) AS doc_id FROM u WHERE key NOT IN (SELECT {O.leak_key('text')} FROM benchmark) GROUP BY key, lang")
def merge_sources(spark, sf):
    train, held = roles(spark, sf)
    blocked = table(spark, sf, "benchmark").select(X.leak_key(F.col("text")).alias("key"))
    return C.without_leaks(train.unionByName(held), blocked, "key").groupBy("key", "lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"WITH {_KEYED} SELECT min(doc_id) AS doc_id, source FROM k GROUP BY key, source")
def dedup_pair(spark, sf):
    return keyed(spark, sf).groupBy("key", "source").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query(f"WITH {_KEYED} SELECT doc_id FROM k WHERE key NOT IN (SELECT key FROM k GROUP BY key HAVING count(DISTINCT source) > 1)")
def dedup_conflict_drop_all(spark, sf):
    return C.without_conflicts(digested(spark, sf), "key", "source").select("doc_id")


@query(f"""WITH {_KEYED}, a AS (SELECT 'exact' AS kind, count(*) AS n FROM documents GROUP BY text UNION ALL SELECT 'normalised', count(*) FROM k GROUP BY key)
SELECT kind, sum(n)::BIGINT AS n_rows, count(*)::BIGINT AS n_groups FROM a WHERE n > 1 GROUP BY kind""")
def dup_stats(spark, sf):
    d = docs(spark, sf)
    one = d.groupBy("text").count().select(F.lit("exact").alias("kind"), "count")
    two = d.groupBy(X.leak_key(F.col("text"))).count().select(F.lit("normalised").alias("kind"), "count")
    return one.union(two).filter("count > 1").groupBy("kind").agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_groups"))


@query(f"WITH {_KEYED}, c AS (SELECT key FROM k GROUP BY key HAVING count(DISTINCT source) > 1) SELECT 'conflicting_label' AS issue, doc_id, source FROM k WHERE key IN (FROM c)")
def conflict_list(spark, sf):
    k = digested(spark, sf)
    found = k.join(C.conflicting_keys(k, "key", "source").select("key"), "key", "left_semi")
    return found.select(F.lit("conflicting_label").alias("issue"), "doc_id", "source")


def _ranked(order: str) -> str:
    return f"(SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY {order}, doc_id) AS n, count(*) OVER (PARTITION BY source) AS size FROM documents)"


_HASH = "md5(concat(doc_id::VARCHAR, '|42'))"


@query(f"SELECT doc_id, source FROM {_ranked('doc_id DESC')} WHERE n <= 20")
def cap_tail(spark, sf):
    return C.top_per_label(docs(spark, sf).select("doc_id", "source"), "source", -F.col("doc_id"), 20, "doc_id")


@query(f"SELECT doc_id, source FROM {_ranked(_HASH)} WHERE n <= 20 OR source = 'src0'")
def cap_sample_exempt(spark, sf):
    d, exempt = docs(spark, sf).select("doc_id", "source"), F.col("source") == "src0"
    return C.top_per_label(d.filter(~exempt), "source", C.shuffled(42, "doc_id"), 20, "doc_id").union(d.filter(exempt))


@query(f"SELECT doc_id, source FROM {_ranked('doc_id')} WHERE n <= 20")
def cap_head(spark, sf):
    return C.top_per_label(docs(spark, sf).select("doc_id", "source"), "source", F.col("doc_id"), 20, "doc_id")


@query("SELECT doc_id, lang, unnest(range(1, CASE WHEN lang = 'es' THEN 4 ELSE 2 END))::INT AS copy FROM documents")
def oversample_class(spark, sf):
    return C.oversampled(docs(spark, sf).select("doc_id", "lang"), F.col("lang") == "es", 3)


@query(f"WITH h AS (SELECT d.doc_id, d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_HASH}, doc_id) AS n FROM h) SELECT doc_id, source, unnest(range(1, 3))::INT AS copy FROM r WHERE n <= 10")
def oversample_hard(spark, sf):
    hard = docs(spark, sf).select("doc_id", "source").join(table(spark, sf, "labels").filter("quality = 0").select("doc_id"), "doc_id")
    return C.oversampled(C.top_per_label(hard, "source", C.shuffled(42, "doc_id"), 10, "doc_id"), F.lit(True), 2)


@query("WITH c AS (SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source) SELECT source, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def class_weights(spark, sf):
    return C.class_weights(docs(spark, sf), "source").withColumn("weight", F.round("weight", 6))


@query(f"SELECT doc_id, source, CASE WHEN n * 5 <= size THEN 'holdout' ELSE 'train' END AS split FROM {_ranked(_HASH)}")
def split_strat(spark, sf):
    r = C.ranked(docs(spark, sf).select("doc_id", "source"), "source", 42, "doc_id")
    return r.select("doc_id", "source", F.when(F.col("rank") * 5 <= F.col("size"), "holdout").otherwise("train").alias("split"))


@query(f"""WITH {_DIGESTED}, g AS (SELECT key, min(doc_id) AS first_id FROM k GROUP BY key), l AS (SELECT g.key, k.source FROM g JOIN k ON k.doc_id = g.first_id),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat(key, '|42')), key) AS n, count(*) OVER (PARTITION BY source) AS size FROM l)
SELECT k.doc_id, CASE WHEN size >= 20 AND n <= greatest(1, floor(size * 15 / 100)) THEN 'holdout' ELSE 'train' END AS split FROM k JOIN r USING (key)""")
def split_group_holdout(spark, sf):
    k = digested(spark, sf)
    groups = k.groupBy("key").agg(F.min(F.struct("doc_id", "source"))["source"].alias("label"))
    groups = C.ranked(groups, "label", 42, "key")
    held = (F.col("size") >= 20) & (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("size") * 15 / 100)))
    return k.join(groups.select("key", held.alias("held")), "key").select("doc_id", F.when(F.col("held"), "holdout").otherwise("train").alias("split"))


@query(f"""WITH {_DIGESTED}, g AS (SELECT key, min(source) AS label, count(*) AS size FROM k GROUP BY key),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY label ORDER BY md5(concat(key, '|42')), key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY label) AS total FROM g)
SELECT label, CASE WHEN before * 10 < total THEN 'test' WHEN before * 5 < total THEN 'val' ELSE 'train' END AS split, sum(size)::BIGINT AS n FROM r GROUP BY ALL""")
def split_groups_greedy(spark, sf):
    g = digested(spark, sf).groupBy("key").agg(F.min("source").alias("label"), F.count("*").alias("rows"))
    g = C.ranked(g, "label", 42, "key", weight="rows")
    split = F.when(F.col("before") * 10 < F.col("total"), "test").when(F.col("before") * 5 < F.col("total"), "val").otherwise("train")
    return g.select("label", "rows", split.alias("split")).groupBy("label", "split").agg(F.sum("rows").alias("n"))


@query(f"WITH c AS (SELECT DISTINCT {O.core_key('text')} AS core, lang FROM documents), r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(core, '|42')), core) AS n, count(*) OVER (PARTITION BY lang) AS size FROM c) SELECT lang, CASE WHEN n <= floor(size * 0.1::DOUBLE) THEN 'dev' WHEN n <= floor(size * 0.1::DOUBLE) + floor(size * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split, count(*)::BIGINT AS n FROM r GROUP BY ALL")
def split_core(spark, sf):
    cores = C.ranked(docs(spark, sf).select(X.core_key(F.col("text")).alias("core"), "lang").distinct(), "lang", 42, "core")
    dev, test = F.floor(F.col("size") * 0.1), F.floor(F.col("size") * 0.2)
    split = F.when(F.col("rank") <= dev, "dev").when(F.col("rank") <= dev + test, "test").otherwise("train")
    return cores.groupBy("lang", split.alias("split")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CASE WHEN n % 2 = 0 THEN 'test' ELSE 'dev' END AS split FROM {_ranked(_HASH)}")
def split_dev_test_alt(spark, sf):
    r = C.ranked(docs(spark, sf).select("doc_id", "source"), "source", 42, "doc_id")
    return r.select("doc_id", F.when(F.col("rank") % 2 == 0, "test").otherwise("dev").alias("split"))


@query(f"""WITH RECURSIVE k AS MATERIALIZED (SELECT doc_id, {O.norm_key('text')} AS norm, {O.group_key('text')} AS grp FROM documents),
l AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY norm) AS b FROM k UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY grp) FROM k), e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS found FROM k UNION SELECT e.b, r.found FROM r JOIN e ON e.a = r.node) SELECT node AS doc_id, min(found) AS group_id FROM r GROUP BY node""")
def connected_groups(spark, sf):
    k = docs(spark, sf).select("doc_id", X.norm_key(F.col("text")).alias("norm"), X.group_key(F.col("text")).alias("grp"))
    firsts = [k.groupBy(c).agg(F.min("doc_id").alias("b")) for c in ("norm", "grp")]
    edges = [k.join(f, c).select(F.col("doc_id").alias("a"), "b") for c, f in zip(("norm", "grp"), firsts, strict=True)]
    return C.connected(edges[0].union(edges[1])).select(F.col("node").alias("doc_id"), F.col("group").alias("group_id"))


@query(f"SELECT doc_id, ((n - 1) % 5)::INT AS fold FROM {_ranked(_HASH)}")
def kfold_oof(spark, sf):
    r = C.ranked(docs(spark, sf).select("doc_id", "source"), "source", 42, "doc_id")
    return r.select("doc_id", ((F.col("rank") - 1) % 5).cast("int").alias("fold"))


@query("SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source HAVING count(*) < 60")
def fold_min_check(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count("*").alias("n")).filter("n < 60")


@query(f"""SELECT doc_id, 'drop_plural' AS op, regexp_replace({O.loose_key('text')}, '([a-z]{{3,}})s( |$)', '\\1\\2', 'g') AS text FROM documents
UNION ALL SELECT doc_id, 'cut_tail', regexp_replace({O.loose_key('text')}, ' [^ ]+$', '') FROM documents UNION ALL SELECT doc_id, 'filler', 'um ' || {O.loose_key('text')} FROM documents""")
def stt_corrupt(spark, sf):
    d, t = docs(spark, sf), X.loose_key(F.col("text"))
    ops = {"drop_plural": F.regexp_replace(t, "([a-z]{3,})s( |$)", "$1$2"), "cut_tail": F.regexp_replace(t, " [^ ]+$", ""), "filler": F.concat(F.lit("um "), t)}
    return d.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("op"), v.alias("text")) for k, v in ops.items()))).alias("x")).select("doc_id", "x.*")


@query(f"""WITH w AS (SELECT doc_id, {O.words('text')} AS words FROM documents)
SELECT doc_id, array_to_string(list_transform(words, lambda w, i: CASE WHEN length(w) > 3 AND (doc_id + i - 1) % 7 = 0 THEN left(w, 1) || substring(w, 3, 1) || substring(w, 2, 1) || substring(w, 4)
 WHEN length(w) > 3 AND (doc_id + i - 1) % 7 = 1 THEN left(w, 1) || substring(w, 3) WHEN length(w) > 3 AND (doc_id + i - 1) % 7 = 2 THEN left(w, 2) || substring(w, 2) ELSE w END), ' ') AS text FROM w""")
def typo_corrupt(spark, sf):
    def bent(w: Column, i: Column) -> Column:
        kind, long = (F.col("doc_id") + i) % 7, F.length(w) > 3
        at = lambda a, n=1 << 30: F.substring(w, a, n)
        return F.when(long & (kind == 0), F.concat(at(1, 1), at(3, 1), at(2, 1), at(4))).when(long & (kind == 1), F.concat(at(1, 1), at(3))).when(long & (kind == 2), F.concat(at(1, 2), at(2))).otherwise(w)

    return docs(spark, sf).select("doc_id", F.array_join(F.transform(X.words(F.col("text")), bent), " ").alias("text"))


@query(f"""WITH w AS (SELECT doc_id, {O.words('text')} AS words FROM documents)
SELECT doc_id, 'unk' AS kind, array_to_string(list_transform(words, lambda w, i: CASE WHEN (doc_id + 3 * (i - 1)) % 10 < 8 THEN 'unk' ELSE w END), ' ') AS text FROM w
UNION ALL SELECT doc_id, 'robust', array_to_string(list_transform(words, lambda w, i: CASE WHEN i - 1 = doc_id % greatest(1, len(words)) THEN 'unk' ELSE w END), ' ') FROM w""")
def unk_aug(spark, sf):
    w = docs(spark, sf).select("doc_id", X.words(F.col("text")).alias("words"))
    unk = F.transform("words", lambda w, i: F.when((F.col("doc_id") + 3 * i) % 10 < 8, F.lit("unk")).otherwise(w))
    robust = F.transform("words", lambda w, i: F.when(i == F.col("doc_id") % F.greatest(F.lit(1), F.size("words")), F.lit("unk")).otherwise(w))
    return w.select("doc_id", F.lit("unk").alias("kind"), F.array_join(unk, " ").alias("text")).union(w.select("doc_id", F.lit("robust"), F.array_join(robust, " ")))


@query(f"""WITH w AS (SELECT doc_id, {O.words('text')} AS words FROM documents)
SELECT doc_id, array_to_string(list_reverse(words), ' ') AS reversed, array_to_string(list_transform(list_sort(list_transform(words, lambda w, i: {{'h': md5(concat(w, '|', (i - 1)::VARCHAR)), 'w': w}})), lambda s: s.w), ' ') AS shuffled FROM w""")
def word_shuffle_probe(spark, sf):
    w = docs(spark, sf).select("doc_id", X.words(F.col("text")).alias("words"))
    hashed = F.array_sort(F.transform("words", lambda w, i: F.struct(F.md5(F.concat(w, F.lit("|"), i.cast("string"))).alias("h"), w.alias("w"))))
    return w.select("doc_id", F.array_join(F.reverse("words"), " ").alias("reversed"), F.array_join(F.transform(hashed, lambda s: s["w"]), " ").alias("shuffled"))


_FORMS = (("fix_it", "it is {s} please {a} it"), ("ask", "why is it {s} and how to {a} it"))


@query(f"""WITH s AS (SELECT DISTINCT p_name AS state FROM part), a AS (SELECT DISTINCT p_type AS action FROM part), t(label, form) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _FORMS)}),
e AS (SELECT label, replace(replace(form, '{{s}}', state), '{{a}}', action) AS text FROM s, a, t), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(text), text) AS n FROM e) SELECT label, text FROM r WHERE n <= 40""")
def template_expand(spark, sf):
    """Every template filled with all names and types of the parts, forty texts a label: a template's fillings are its feature."""
    part = table(spark, sf, "part")
    fillings = part.select(F.col("p_name").alias("state")).distinct().join(part.select(F.col("p_type").alias("action")).distinct())
    filled = [F.struct(F.lit(label).alias("label"), F.replace(F.replace(F.lit(form), F.lit("{s}"), F.col("state")), F.lit("{a}"), F.col("action")).alias("text")) for label, form in _FORMS]
    return C.top_per_label(fillings.select(F.inline(F.array(*filled))), "label", F.md5("text"), 40, "text")


@query(f"WITH {_ROLES} SELECT doc_id, 'train' AS origin FROM train UNION ALL SELECT doc_id, 'generated' FROM (SELECT doc_id, key || ' again' AS key FROM k) WHERE key NOT IN (SELECT key FROM held)")
def augment_train_only(spark, sf):
    train, held = roles(spark, sf)
    made = keyed(spark, sf).select("doc_id", F.concat("key", F.lit(" again")).alias("key"))
    return train.select("doc_id", F.lit("train").alias("origin")).union(C.without_leaks(made, held, "key").select("doc_id", F.lit("generated")))


@query("SELECT unnest([o_orderkey, o_orderkey]) AS pair_id, unnest(['a', 'b']) AS side, unnest([o_orderstatus, o_orderpriority]) AS text FROM orders")
def minimal_pairs_long(spark, sf):
    o = table(spark, sf, "orders")
    return o.selectExpr("o_orderkey AS pair_id", "stack(2, 'a', o_orderstatus, 'b', o_orderpriority) AS (side, text)")


@query(f"""WITH {_ROLES}, v AS (SELECT DISTINCT unnest(string_split(key, ' ')) AS word FROM train), w AS (SELECT doc_id, key, unnest(string_split(key, ' ')) AS word FROM held),
o AS (SELECT doc_id, count(*) FILTER (word NOT IN (SELECT word FROM v)) AS unseen FROM w GROUP BY doc_id)
SELECT doc_id, CASE WHEN key IN (SELECT key FROM train) THEN 'seen' WHEN unseen = 0 THEN 'no_oov' ELSE 'kept' END AS reason FROM held JOIN o USING (doc_id)""")
def validate_oov_rows(spark, sf):
    train, held = roles(spark, sf)
    vocabulary = train.select(F.explode(F.split("key", " ")).alias("word")).distinct().withColumn("known", F.lit(True))
    words = held.select("doc_id", F.explode(F.split("key", " ")).alias("word")).join(vocabulary, "word", "left")
    unseen = words.groupBy("doc_id").agg(F.count_if(F.col("known").isNull()).alias("unseen"))
    seen = train.select("key").distinct().withColumn("seen", F.lit(True))
    reason = F.when(F.col("seen"), "seen").when(F.col("unseen") == 0, "no_oov").otherwise("kept")
    return held.join(unseen, "doc_id").join(seen, "key", "left").select("doc_id", reason.alias("reason"))


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT count(*)::BIGINT AS labels, sum(n)::BIGINT AS n_rows, max(n)::BIGINT AS most, min(n)::BIGINT AS least, median(n)::DOUBLE AS mid, round(max(n) / min(n), 6) AS imbalance FROM c")
def count_by_label(spark, sf):
    c = docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("labels"), F.sum("n").alias("n_rows"), F.max("n").alias("most"), F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("mid"), F.round(F.max("n") / F.min("n"), 6).alias("imbalance"))


@query(f"WITH w AS (SELECT lang, len({O.words('text')}) AS n FROM documents) SELECT lang, quantile_cont(n, 0.1)::DOUBLE AS p10, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.9)::DOUBLE AS p90, max(n)::BIGINT AS most, count(*) FILTER (n < 3)::BIGINT AS short FROM w GROUP BY lang".replace("0.1)::DOUBLE", "0.1::DOUBLE)::DOUBLE"))
def length_profile(spark, sf):
    w = docs(spark, sf).select("lang", F.size(X.words(F.col("text"))).alias("n"))
    p = lambda q: F.percentile("n", F.lit(q))
    return w.groupBy("lang").agg(p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.max("n").cast("long").alias("most"), F.count_if(F.col("n") < 3).alias("short"))


def _tokens(spark, sf) -> DataFrame:
    return docs(spark, sf).select("doc_id", "lang", F.explode(X.token_list(F.col("text"))).alias("token"))


_TOKENS = f"t AS (SELECT doc_id, lang, unnest({O.token_list('text')}) AS token FROM documents)"


@query(f"WITH {_TOKENS} SELECT token, count(*)::BIGINT AS n FROM t GROUP BY token HAVING count(*) >= 2")
def vocab_freq(spark, sf):
    return _tokens(spark, sf).groupBy("token").agg(F.count("*").alias("n")).filter("n >= 2")


@query(f"""WITH {_TOKENS}, f AS (SELECT token, count(*) AS n FROM t GROUP BY token), p AS (SELECT unnest(list_transform(range(1, length(token) - 1), lambda i: substring(token, i, 3))) AS piece, n FROM f WHERE length(token) >= 3)
SELECT piece, (sum(n) * 3)::BIGINT AS score FROM p GROUP BY piece""")
def subword_vocab(spark, sf):
    f = _tokens(spark, sf).groupBy("token").agg(F.count("*").alias("n")).filter(F.length("token") >= 3)
    pieces = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 2), lambda i: F.substring("token", i, F.lit(3))))
    return f.select(pieces.alias("piece"), "n").groupBy("piece").agg((F.sum("n") * 3).alias("score"))


@query(f"""WITH {_TOKENS}, d AS (SELECT lang, token, count(DISTINCT doc_id) AS df FROM t GROUP BY ALL), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), k AS (SELECT token, count(*) AS k FROM d GROUP BY token),
s AS (SELECT lang, token, df, round(df / n * ln((SELECT count(*) FROM n) / k), 6) AS score FROM d JOIN n USING (lang) JOIN k USING (token) WHERE df >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, token) AS place FROM s)
SELECT lang, token, df::BIGINT AS df, score FROM r WHERE place <= 8""")
def distinctive_tokens(spark, sf):
    df = _tokens(spark, sf).groupBy("lang", "token").agg(F.countDistinct("doc_id").alias("df"))
    n = docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))
    spread = df.groupBy("token").agg(F.count("*").alias("k"))
    labels = n.agg(F.count("*").alias("labels"))
    s = df.filter("df >= 3").join(F.broadcast(n), "lang").join(spread, "token").crossJoin(F.broadcast(labels))
    s = s.withColumn("score", F.round(F.col("df") / F.col("n") * F.ln(F.col("labels") / F.col("k")), 6))
    return C.top_per_label(s.select("lang", "token", "df", "score"), "lang", -F.col("score"), 8, "token")


@query(f"""WITH {_TOKENS}, d AS (SELECT lang, token, count(DISTINCT doc_id) AS df FROM t GROUP BY ALL), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), k AS (SELECT token, count(*) AS k FROM d GROUP BY token)
SELECT lang, token, round(df / n, 6) AS coverage FROM d JOIN n USING (lang) JOIN k USING (token) WHERE df / n >= 0.6 AND k <= 2""")
def shortcut_risk(spark, sf):
    df = _tokens(spark, sf).groupBy("lang", "token").agg(F.countDistinct("doc_id").alias("df"))
    n = docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))
    spread = df.groupBy("token").agg(F.count("*").alias("k")).filter("k <= 2")
    coverage = F.col("df") / F.col("n")
    return df.join(F.broadcast(n), "lang").filter(coverage >= 0.6).join(spread, "token").select("lang", "token", F.round(coverage, 6).alias("coverage"))


_PROBES = ("the", "que", "der", "and", "with")


@query(f"""WITH p AS (SELECT unnest({list(_PROBES)}) AS word), h AS (SELECT word, lang, count(*) AS n FROM documents JOIN p ON regexp_matches(lower(text), concat('(^|[^a-z])', word, '([^a-z]|$)')) GROUP BY ALL),
s AS (SELECT word, sum(n) AS total, max(n) AS top FROM h GROUP BY word) SELECT word, total::BIGINT AS total, round(top / total, 6) AS share, top / total > 0.65 AS flagged FROM s WHERE total >= 5""")
def shortcut_share(spark, sf):
    low = F.lower("text")
    hits = F.filter(F.array(*(F.when(low.rlike(f"(^|[^a-z]){w}([^a-z]|$)"), F.lit(w)) for w in _PROBES)), F.isnotnull)
    h = docs(spark, sf).select("lang", F.explode(hits).alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    s = h.groupBy("word").agg(F.sum("n").alias("total"), F.max("n").alias("top")).filter("total >= 5")
    share = F.col("top") / F.col("total")
    return s.select("word", "total", F.round(share, 6).alias("share"), (share > 0.65).alias("flagged"))


@query("""WITH s AS (SELECT lang, 1 - avg(CASE WHEN regexp_matches(lower(text), '(^| )(how|comment|wie|como)( |$)') THEN 1.0 ELSE 0.0 END)::DOUBLE AS share FROM documents GROUP BY lang)
SELECT lang, round(share, 6) AS share, CASE WHEN share >= 0.65 THEN 'action' WHEN share <= 0.35 THEN 'howto' ELSE 'mixed' END AS kind FROM s""")
def action_share_kind(spark, sf):
    share = 1 - F.avg(F.lower("text").rlike("(^| )(how|comment|wie|como)( |$)").cast("double"))
    s = docs(spark, sf).groupBy("lang").agg(share.alias("s"))
    return s.select("lang", F.round("s", 6).alias("share"), F.when(F.col("s") >= 0.65, "action").when(F.col("s") <= 0.35, "howto").otherwise("mixed").alias("kind"))


@query(f"WITH c AS (SELECT {O.core_key('text')} AS core, source FROM documents), k AS (SELECT count(*) FILTER (n > 1) AS collisions FROM (SELECT count(DISTINCT source) AS n FROM c GROUP BY core)) SELECT round(1 - count(DISTINCT core) / count(*), 6) AS inflation, (SELECT collisions FROM k)::BIGINT AS collisions FROM c")
def template_inflation(spark, sf):
    c = docs(spark, sf).groupBy(X.core_key(F.col("text")).alias("core")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("labels"))
    return c.agg(F.round(1 - F.count("*") / F.sum("n"), 6).alias("inflation"), F.count_if(F.col("labels") > 1).alias("collisions"))


@query(f"WITH p AS (SELECT unnest({list(_PROBES)}) AS word) SELECT word, lang, count(*)::BIGINT AS n FROM documents JOIN p ON contains(lower(text), word) GROUP BY ALL")
def polarity_report(spark, sf):
    low = F.lower("text")
    hits = F.filter(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in _PROBES)), F.isnotnull)
    return docs(spark, sf).select("lang", F.explode(hits).alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))


@query("SELECT lang, round(avg((contains(lower(text), 'the') AND contains(lower(text), 'ing'))::INT), 6) AS share FROM documents GROUP BY lang")
def contrastive_coverage(spark, sf):
    both = F.contains(F.lower("text"), F.lit("the")) & F.contains(F.lower("text"), F.lit("ing"))
    return docs(spark, sf).groupBy("lang").agg(F.round(F.avg(both.cast("int")), 6).alias("share"))


@query(f"SELECT {O.token_set('text')} AS tokens, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING bool_or(source IN {_IN}) AND bool_or(source NOT IN {_IN})")
def contradictory_toksets(spark, sf):
    held = F.col("source").isin(*HELD_OUT)
    g = docs(spark, sf).groupBy(X.token_set(F.col("text")).alias("tokens")).agg(F.count("*").alias("n"), F.bool_or(held).alias("a"), F.bool_or(~held).alias("b"))
    return g.filter("a AND b").select("tokens", "n")


@query("""WITH b AS (SELECT event_type, count(*) AS before FROM events WHERE ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY 1), a AS (SELECT event_type, count(*) AS after FROM events GROUP BY 1)
SELECT event_type, coalesce(before, 0)::BIGINT AS before, (coalesce(after, 0) - coalesce(before, 0))::BIGINT AS added, coalesce(after, 0)::BIGINT AS after, round(100 * (after - before) / before, 6) AS pct FROM b FULL JOIN a USING (event_type)""".replace("(max(ts) - min(ts)) / 2", "to_microseconds((epoch_us(max(ts)) - epoch_us(min(ts))) // 2)"))
def distribution_delta(spark, sf):
    e = table(spark, sf, "events").withColumn("us", F.unix_micros("ts"))
    cut = e.agg((F.min("us") + F.floor((F.max("us") - F.min("us")) / 2)).alias("cut"))
    c = e.crossJoin(F.broadcast(cut)).groupBy("event_type").agg(F.count_if(F.col("us") < F.col("cut")).alias("before"), F.count("*").alias("after"))
    return c.select("event_type", "before", (F.col("after") - F.col("before")).alias("added"), "after", F.round(100 * (F.col("after") - F.col("before")) / F.expr("nullif(before, 0)"), 6).alias("pct"))


@query(f"""WITH v AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) AS n, {O.leak_key('text')} AS key FROM documents), c AS (SELECT * FROM v WHERE n <= 10)
SELECT min(doc_id) AS doc_id FROM c GROUP BY key""")
def cap_per_language_then_concat(spark, sf):
    d = docs(spark, sf).select("doc_id", F.struct("lang", "source").alias("label"), "text")
    capped = C.top_per_label(d, "label", -F.col("doc_id"), 10, "doc_id")
    return capped.groupBy(X.leak_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"""WITH {_KEYED}, i AS (SELECT doc_id, key, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM k WHERE lang <> 'es'), o AS (SELECT doc_id, key FROM k WHERE lang = 'es' AND key NOT IN (SELECT key FROM k WHERE source IN {_IN}))
SELECT doc_id, 'in_scope' AS origin FROM i WHERE n <= 15 UNION ALL SELECT doc_id, 'oos' FROM o""")
def oos_curated_merge(spark, sf):
    k = keyed(spark, sf)
    inside = C.top_per_label(k.filter("lang <> 'es'"), "source", F.col("doc_id"), 15, "doc_id").select("doc_id", F.lit("in_scope").alias("origin"))
    oos = C.without_leaks(k.filter("lang = 'es'"), k.filter(F.col("source").isin(*HELD_OUT)), "key")
    return inside.union(oos.select("doc_id", F.lit("oos")))


@query(f"WITH {_ROLES} SELECT h.doc_id FROM documents h WHERE h.source IN {_IN} AND lower(trim(text, ' ')) NOT IN (SELECT lower(trim(text, ' ')) FROM documents WHERE source NOT IN {_IN})")
def new_vs_train_pool(spark, sf):
    d = docs(spark, sf).select("doc_id", "source", F.lower(F.trim("text")).alias("key"))
    held = F.col("source").isin(*HELD_OUT)
    return C.without_leaks(d.filter(held), d.filter(~held), "key").select("doc_id")


@query(f"""WITH {_KEYED}, b AS (SELECT source, count(*) AS n_rows, count(DISTINCT key) AS n_unique FROM k GROUP BY source), a AS (SELECT source, count(DISTINCT key) AS added FROM k WHERE key NOT IN (SELECT key FROM k x WHERE x.lang = 'en') GROUP BY source)
SELECT source, n_rows::BIGINT AS n_rows, n_unique::BIGINT AS n_unique, coalesce(added, 0)::BIGINT AS added FROM b LEFT JOIN a USING (source)""")
def vocab_coverage(spark, sf):
    k = keyed(spark, sf)
    english = k.filter("lang = 'en'").select("key").distinct().withColumn("english", F.lit(True))
    g = k.join(english, "key", "left").groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_unique"), F.countDistinct(F.when(F.col("english").isNull(), F.col("key"))).alias("added"))
    return g


@query(f"WITH p AS (SELECT DISTINCT {O.loose_key('text')} AS phrase, source FROM documents WHERE source NOT IN {_IN}), t AS (SELECT DISTINCT {O.loose_key('text')} AS phrase FROM documents WHERE source IN {_IN}) SELECT phrase, count(DISTINCT source) > 1 AS ambiguous FROM p WHERE phrase NOT IN (FROM t) GROUP BY phrase")
def candidate_phrase_filter(spark, sf):
    d = docs(spark, sf).select(X.loose_key(F.col("text")).alias("phrase"), "source")
    held = F.col("source").isin(*HELD_OUT)
    left = C.without_leaks(d.filter(~held), d.filter(held), "phrase")
    return left.groupBy("phrase").agg((F.countDistinct("source") > 1).alias("ambiguous"))


@query(f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_HASH}, doc_id) AS n FROM documents)
SELECT doc_id AS a, coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY n), first(doc_id) OVER (PARTITION BY source ORDER BY n)) AS b FROM r QUALIFY count(*) OVER (PARTITION BY source) >= 2""")
def positive_pairs_ring(spark, sf):
    r = C.checkpointed(C.ranked(docs(spark, sf).select("doc_id", "source"), "source", 42, "doc_id")).filter("size >= 2")
    after = r.select("source", F.col("rank").alias("next"), F.col("doc_id").alias("b"))
    return r.withColumn("next", F.col("rank") % F.col("size") + 1).join(after, ["source", "next"]).select(F.col("doc_id").alias("a"), "b")


@query(f"WITH w AS (SELECT lang, len({O.words('text')}) AS n FROM documents), s AS (SELECT avg(n) FILTER (lang = 'en') AS a, avg(n) FILTER (lang <> 'en') AS b FROM w) SELECT round(a, 6) AS mean_a, round(b, 6) AS mean_b, abs(a - b) <= 1.0 AS balanced FROM s")
def balance_length_assert(spark, sf):
    n, english = F.size(X.words(F.col("text"))), F.col("lang") == "en"
    s = docs(spark, sf).agg(F.avg(F.when(english, n)).alias("a"), F.avg(F.when(~english, n)).alias("b"))
    return s.select(F.round("a", 6).alias("mean_a"), F.round("b", 6).alias("mean_b"), (F.abs(F.col("a") - F.col("b")) <= 1.0).alias("balanced"))


@query(f"WITH {_TOKENS} SELECT token FROM t WHERE lang = 'en' INTERSECT SELECT token FROM t WHERE lang = 'de'")
def disjoint_nouns_assert(spark, sf):
    t = _tokens(spark, sf)
    return t.filter("lang = 'en'").select("token").intersect(t.filter("lang = 'de'").select("token"))


@query(f"SELECT doc_id, regexp_matches({O.loose_key('text')}, '  |(^| )a a( |$)|\\| \\|') AS malformed FROM documents".replace("\\\\|", "\\|"))
def wellformed_assert(spark, sf):
    return docs(spark, sf).select("doc_id", X.loose_key(F.col("text")).rlike(r"  |(^| )a a( |$)|\| \|").alias("malformed"))


_ANCHORS = ("the ", "secret", "password", "license", "zzz")


@query(f"WITH a AS (SELECT unnest({list(_ANCHORS)}) AS anchor) SELECT anchor, count(doc_id)::BIGINT AS n FROM a LEFT JOIN documents ON contains(lower(text), anchor) GROUP BY anchor HAVING count(doc_id) <= 3")
def foreign_anchor_measure(spark, sf):
    low = F.lower("text")
    counts = docs(spark, sf).agg(*(F.count_if(F.contains(low, F.lit(a))).alias(f"n{i}") for i, a in enumerate(_ANCHORS)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("anchor"), F.col(f"n{i}").alias("n")) for i, a in enumerate(_ANCHORS))))
    return counts.select(rows.alias("x")).select("x.*").filter("n <= 3")


@query(f"""WITH {_KEYED}, d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM k WHERE lang <> 'en'), e AS (SELECT DISTINCT key FROM k WHERE lang = 'en')
SELECT doc_id, CASE WHEN n > 1 THEN 'duplicate' WHEN key IN (FROM e) THEN 'verbatim' WHEN contains(key, ' the ') THEN 'token' ELSE 'kept' END AS reason FROM d""")
def ood_validate_chain(spark, sf):
    k = keyed(spark, sf)
    first = k.filter("lang <> 'en'").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    english = k.filter("lang = 'en'").select("key").distinct().withColumn("english", F.lit(True))
    rows = k.filter("lang <> 'en'").join(first, "key").join(english, "key", "left")
    reason = F.when(F.col("doc_id") != F.col("first_id"), "duplicate").when(F.col("english"), "verbatim").when(F.contains("key", F.lit(" the ")), "token").otherwise("kept")
    return rows.select("doc_id", reason.alias("reason"))
