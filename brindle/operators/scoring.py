"""Scoring: prototypes, softmax with temperature, margins, TF-IDF and linear models, gates.

Models are small tables (a row for each label or term). Dense scores stay in arrays, so scoring a row is a
projection without any shuffle; sparse scores are joins on the term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rows import once
from brindle.operators.corpus import shuffled, stored, top_per_label
from brindle.operators.token_sort import SALTS, best_ratios
from brindle.operators.token_sort import common_length as common_length


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, mean): the mean vector of each label; partial sums run before the shuffle."""
    cells = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x"))
    cells = cells.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def prototypes(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, w): unit vectors in the direction of the centroids."""
    c = centroids(df, vector, label)
    return c.select("label", F.transform("mean", lambda x: x / norm(F.col("mean"))).alias("w"))


def with_logits(df: DataFrame, vector: str, model: DataFrame, name: str = "z") -> DataFrame:
    """``df`` with an array of (label, z), by label. The model has a row for each label and travels by broadcast."""
    packed = model.agg(F.array_sort(F.collect_list(F.struct("label", "w"))).alias("__model"))
    z = F.transform("__model", lambda m: F.struct(m["label"].alias("label"), dot(F.col(vector), m["w"]).alias("z")))
    return once(df.crossJoin(F.broadcast(packed)), **{name: z}).drop("__model")


def softmax(z: Column, temperature: float) -> Column:
    """Probabilities of an array of logits, shifted by the largest."""
    shifted = F.get(F.transform(F.array(F.array_max(z)), lambda top: F.transform(z, lambda x: F.exp((x - top) / temperature))), F.lit(0))
    e = shifted
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    # the array of one holds the sum, which is then taken once and not for each element
    return F.get(F.transform(F.array(F.struct(e.alias("e"), total(e).alias("t"))), lambda s: F.transform(s["e"], lambda x: x / s["t"])), F.lit(0))


def energy(z: Column) -> Column:
    top = F.array_max(z)
    return -(top + F.ln(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def scored(df: DataFrame, temperature: float) -> DataFrame:
    """From ``z``: p, pred, conf, second, margin, entropy; ties go to the smaller label."""
    df = once(df, p=softmax(F.transform("z", lambda s: s["z"]), temperature))
    best = F.reverse(F.array_sort(F.zip_with("p", "z", lambda p, s: F.struct(p.alias("p"), (-s["label"]).alias("l")))))
    df = once(df, __best=best)
    first, second = F.get("__best", F.lit(0)), F.get("__best", F.lit(1))
    mess = F.aggregate("p", F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0)))
    return once(df, pred=-first["l"], conf=first["p"], runner_up=-second["l"], second=second["p"], margin=first["p"] - second["p"], entropy=mess).drop("__best")


def term_counts(terms: DataFrame, doc: str, term: str) -> DataFrame:
    """(doc, term, c): how often each document has each term; the one pass over raw terms that TF-IDF needs."""
    return terms.groupBy(F.col(doc).alias("doc"), F.col(term).alias("term")).agg(F.count("*").alias("c"))


def tfidf_fit(counts: DataFrame, min_df: int = 2) -> DataFrame:
    """(term, df, idf) from term counts, with smooth idf: ln((1 + N) / (1 + df)) + 1."""
    total = counts.select("doc").distinct().agg(F.count("*").alias("__n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    return df.crossJoin(F.broadcast(total)).select("term", "df", (F.ln((1 + F.col("__n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_vectors(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(doc, term, w) from term counts: (1 + ln count) * idf, of unit length over the known terms."""
    raw = counts.join(idf.select("term", "idf"), "term").withColumn("w", (1 + F.ln("c")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("w") / length).alias("w"))


def linear_logits(docs: DataFrame, vectors: DataFrame, weights: DataFrame, bias: DataFrame) -> DataFrame:
    """(doc, label, z) for each document and label, those without known terms too: W x + b."""
    sums = vectors.join(weights, "term").groupBy("doc", "label").agg(F.sum(F.col("w") * F.col("coef")).alias("s"))
    grid = docs.crossJoin(F.broadcast(bias))
    return grid.join(sums, ["doc", "label"], "left").select("doc", "label", (F.coalesce("s", F.lit(0.0)) + F.col("b")).alias("z"))


def set_classes(rows: DataFrame, block: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Of (id, tokens, block): one row for each different token set, (id, tokens, block, copies) with its smallest id,
    and (id, rep) for every row. Sets are told apart by their tokens, sorted; empty sets are left out."""
    keys = [block] if block else []
    rows = rows.filter(F.size("tokens") > 0).select("id", *keys, F.array_sort("tokens").alias("tokens"))
    classes = rows.groupBy(*keys, "tokens").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = rows.join(classes.filter("copies > 1").drop("copies"), [*keys, "tokens"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return classes.withColumnRenamed("rep", "id"), members


def prefix_pairs(rows: DataFrame, threshold: float, block: str | None = None) -> DataFrame:
    """(a, b, sim) of all pairs of token sets with Jaccard similarity of ``threshold`` or more, a < b.

    ``rows`` has id, tokens (distinct) and, if pairs must share it, the block column; the sets should differ, see
    ``set_classes``. Prefix filtering: tokens are ordered from rare to common, and two sets that similar share one of
    their first tokens, so only those are joined on; the lengths must fit as well.
    """
    keys = [block] if block else []
    freq = rows.select(*keys, F.explode("tokens").alias("t")).groupBy(*keys, "t").agg(F.count("*").alias("f"))
    flat = rows.select("id", *keys, F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(freq, [*keys, "t"])
    rare = Window.partitionBy("id").orderBy("f", "t")
    first = F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1
    heads = flat.withColumn("place", F.row_number().over(rare)).filter(F.col("place") <= first).select("id", *keys, "n", "t")
    other = heads.select(F.col("id").alias("other"), *keys, F.col("n").alias("m"), "t")
    fits = (F.col("id") < F.col("other")) & (F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m"))
    pairs = heads.join(other, [*keys, "t"]).filter(fits).select("id", "other").distinct()
    a, b = rows.select("id", F.col("tokens").alias("x")), rows.select(F.col("id").alias("other"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    sim = both / (F.size("x") + F.size("y") - both)
    return pairs.join(a, "id").join(b, "other").select(F.col("id").alias("a"), F.col("other").alias("b"), sim.alias("sim")).filter(F.col("sim") >= threshold)


def heavy_terms(vectors: DataFrame, least: float) -> DataFrame:
    """The terms (doc, term, w) of unit vectors without those that no pair of cosine ``least`` or more needs to meet.

    Terms are ordered from rare to common. Of each vector the common end goes whose length is below ``least``: a pair
    whose only common terms are there has a smaller cosine, so every pair of ``least`` or more keeps a common term.
    """
    freq = vectors.groupBy("term").agg(F.count("*").alias("__f"))
    common = Window.partitionBy("doc").orderBy(F.desc("__f"), F.desc("term"))
    tail = F.sum(F.col("w") * F.col("w")).over(common)
    return vectors.join(freq, "term").withColumn("__tail", tail).filter(F.col("__tail") >= least * least).drop("__f", "__tail")


def best_cosine(asked: DataFrame, index: DataFrame, least: float) -> DataFrame:
    """(doc, best): for each vector of ``asked`` (doc, term, w) that has one, the highest cosine of ``least`` or more in ``index``."""
    heads = heavy_terms(asked.withColumn("__asked", F.lit(True)).unionByName(index.withColumn("__asked", F.lit(False))), least)
    a, b = heads.filter("__asked").select("doc", "term"), heads.filter("not __asked").select(F.col("doc").alias("other"), "term")
    pairs = a.join(b, "term").select("doc", "other").distinct()
    x, y = asked.select("doc", "term", "w"), index.select(F.col("doc").alias("other"), "term", F.col("w").alias("x"))
    cosine = pairs.join(x, "doc").join(y, ["other", "term"]).groupBy("doc", "other").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    return cosine.filter(F.col("s") >= least).groupBy("doc").agg(F.max("s").alias("best"))


#: Rows of a block of vectors: two blocks are compared by one matrix product.
VECTORS = 1024


def _blocked(df: DataFrame, id: str, vector: str, size: int) -> DataFrame:
    """(ids, m): blocks of vectors as one array of doubles each, row after row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy()], pa.list_(pa.int64())), pa.array([part.column(1).flatten().to_numpy()], pa.list_(pa.float64()))], names=["ids", "m"])

    return df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "ids array<long>, m array<double>")


def nearest(asked: DataFrame, index: DataFrame, id: str, vector: str, size: int = VECTORS) -> DataFrame:
    """(asked_id, id, score): for each vector of ``asked`` the one of ``index`` with the largest dot product, itself aside.

    A stated set of queries against all rows, in blocks: a pair of blocks is one matrix product, and only the best of
    it goes on; ties go to the smaller id. The queries should be a small share of the index.
    """
    q, r = _blocked(asked, id, vector, size).select(F.col("ids").alias("q_ids"), F.col("m").alias("q")), _blocked(index, id, vector, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, ids, m in zip(*(c for c in batch.columns), strict=True):
                a, b = np.array(q_ids.as_py()), np.array(ids.as_py())
                order = np.argsort(b, kind="stable")
                b = b[order]
                scores = np.array(q.values).reshape(len(a), -1) @ np.array(m.values).reshape(len(b), -1)[order].T
                scores[a[:, None] == b[None, :]] = -np.inf
                at = scores.argmax(1)
                best = scores[np.arange(len(a)), at]
                found = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[at][found]), pa.array(best[found])], names=["asked_id", "id", "score"])

    met = r.crossJoin(q).select("q_ids", "q", "ids", "m").mapInArrow(run, "asked_id long, id long, score double")
    best = F.max(F.struct("score", (-F.col("id")).alias("id")))
    return met.groupBy("asked_id").agg(best.alias("b")).select("asked_id", (-F.col("b.id")).alias("id"), F.col("b.score").alias("score"))


def whitening(df: DataFrame, vector: str, label: str, shrinkage: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(labels' means, precision): of the within-class covariance, shrunken towards a scaled identity.

    Sums and products are added up for each batch in numpy and then by cell, so the driver gets one number for each
    label and dimension, and one for each pair of dimensions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1), batch.column(1).to_numpy()
                d = x.shape[1]
                for c in np.unique(y):
                    part = x[y == c]
                    cells = np.r_[part.sum(0), len(part)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, c)), pa.array(np.arange(d + 1)), pa.array(cells)], names=["label", "cell", "x"])
                yield pa.RecordBatch.from_arrays([pa.nulls(d * d, pa.int64()), pa.array(np.arange(d * d)), pa.array((x.T @ x).ravel())], names=["label", "cell", "x"])

    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("l"))
    cells = rows.mapInArrow(run, "label long, cell long, x double").groupBy("label", "cell").agg(F.sum("x").alias("x")).orderBy("label", "cell").collect()
    d = int(round(math.sqrt(sum(r.label is None for r in cells))))
    total = np.array([r.x for r in cells if r.label is None]).reshape(d, d)
    sums = np.array([r.x for r in cells if r.label is not None]).reshape(-1, d + 1)
    n, means = sums[:, -1], sums[:, :-1] / sums[:, -1:]
    cov = (total - (means * n[:, None]).T @ means) / max(1, n.sum() - len(n))
    cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / d * np.eye(d)
    return means, np.linalg.pinv(cov)


def mahalanobis(df: DataFrame, vector: str, means: np.ndarray, precision: np.ndarray, name: str = "distance") -> DataFrame:
    """``df`` with the distance of each vector to the nearest mean, whitened by the precision's square root."""
    w, v = np.linalg.eigh((precision + precision.T) / 2)
    root = (v * np.sqrt(np.clip(w, 0, None))) @ v.T
    white = means @ root

    @F.pandas_udf("double")
    def distance(x: pd.Series) -> pd.Series:
        z = np.stack(x.to_numpy()) @ root
        d2 = (z**2).sum(1)[:, None] - 2 * z @ white.T + (white**2).sum(1)[None, :]
        return pd.Series(np.sqrt(np.clip(d2.min(1), 0, None)))

    return df.withColumn(name, distance(F.col(vector)))


def softmax_regression(df: DataFrame, vector: str, label: str, labels: int, rounds: int = 60, rate: float = 1.0, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a softmax regression by gradient descent over all rows, one pass a round.

    Each batch adds up its own gradient in numpy; the driver gets one number for each weight and round.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("l"))
    first = rows.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    d, n = first.d, first.n
    w, b = np.zeros((d, labels)), np.zeros(labels)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, b: np.ndarray = b) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d + 1, labels))
            for batch in batches:
                if batch.num_rows:
                    x, y = np.array(batch.column(0).flatten()).reshape(batch.num_rows, d), batch.column(1).to_numpy()
                    z = x @ w + b
                    p = np.exp(z - z.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    p[np.arange(len(y)), y] -= 1
                    total += np.r_[x.T @ p, p.sum(0, keepdims=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "x"])

        cells = rows.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).orderBy("cell").collect()
        g = np.array([r.x for r in cells]).reshape(d + 1, labels) / n
        w, b = w - rate * (g[:d] + l2 * w), b - rate * g[d]
    return w, b


def kmeans(df: DataFrame, id: str, vector: str, label: str, k: int, rounds: int = 20, seed: int = 42) -> dict[tuple[int, int], np.ndarray]:
    """(label, cluster) to centre: k-means within each label, all labels in one pass a round.

    The first centres are the label's first ``k`` rows in a random order; an empty cluster keeps its centre. The
    driver holds the centres alone: ``k`` for each label.
    """
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("l"))
    centres: dict[tuple[int, int], np.ndarray] = {}
    for r in top_per_label(rows, "l", shuffled(seed, "id"), k, "id").orderBy("l", "id").collect():  # k rows a label
        centres[r.l, sum(key[0] == r.l for key in centres)] = np.array(r.v)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], centres: dict = centres) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1), batch.column(1).to_numpy()
                    for c in np.unique(y).tolist():
                        mine = np.stack([centres[key] for key in sorted(centres) if key[0] == c])
                        part = x[y == c]
                        at = ((part[:, None, :] - mine[None, :, :]) ** 2).sum(2).argmin(1)
                        for j in np.unique(at).tolist():
                            cells = np.r_[part[at == j].sum(0), float((at == j).sum())]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), c)), pa.array(np.full(len(cells), j)), pa.array(np.arange(len(cells))), pa.array(cells)], names=["l", "k", "cell", "x"])

        found: dict[tuple[int, int], list[float]] = {}
        for r in rows.select("v", "l").mapInArrow(run, "l long, k long, cell long, x double").groupBy("l", "k", "cell").agg(F.sum("x").alias("x")).orderBy("l", "k", "cell").collect():
            found.setdefault((r.l, r.k), []).append(r.x)
        moved = centres | {key: np.array(x[:-1]) / x[-1] for key, x in found.items()}
        done = all(np.allclose(moved[key], centres[key], rtol=0, atol=1e-12) for key in moved)
        centres = moved
        if done:
            break
    return centres


def pieces(word: str, vocab: set[str]) -> list[str]:
    """Greedy longest match; a character that starts no piece is [UNK]."""
    out, start = [], 0
    while start < len(word):
        mark = "##" if start else ""
        end = next((e for e in range(len(word), start, -1) if mark + word[start:e] in vocab), None)
        out.append("[UNK]" if end is None else mark + word[start:end])
        start = start + 1 if end is None else end
    return out


def wordpieces(words: DataFrame, word: str, vocab: set[str]) -> DataFrame:
    """``words`` with by_character, its pieces joined by spaces, and by_word, [UNK] if any of them is. Words should be different ones."""

    @F.pandas_udf("by_character string, by_word string")
    def cut(column: pd.Series) -> pd.DataFrame:
        found = [pieces(w, vocab) for w in column]
        return pd.DataFrame({"by_character": [" ".join(p) for p in found], "by_word": ["[UNK]" if "[UNK]" in p else " ".join(p) for p in found]})

    return words.withColumn("__cut", cut(F.col(word))).select(*words.columns, "__cut.*")


def nearest_token_sort(asked: DataFrame, rows: DataFrame, id: str, text: str, least: float) -> DataFrame:
    """(id, nn_id, score): for each asked row the most similar other text, by the token-sort ratio in per cent.

    Texts are lower-cased, their words sorted; the ratio is twice the longest common subsequence over both lengths.
    Equal texts count once, with their smallest id, and a text isn't its own neighbour; ties go to the smaller id.
    Only what allows ``least`` is compared, block by block. The asked rows should be a small share.
    """
    key = F.array_join(F.array_sort(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")), " ")
    texts = stored(rows.select(F.col(id).alias("id"), key.alias("text")).filter("text <> ''").groupBy("text").agg(F.min("id").alias("id")))
    own = stored(asked.select(F.col(id).alias("id"), key.alias("text")).filter("text <> ''"))
    classes = stored(own.groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    best = stored(best_ratios(classes, texts, least).withColumnRenamed("id", "nn_id"))
    found = classes.join(best, classes["id"] == best["asked_id"]).select("text", "copies", "asked_id", "nn_id", "score")
    # rows of a class with copies are dealt to its answer by salt, so that no task gets all of a large class
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    many = found.filter("copies > 1").withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    again = own.withColumn("salt", salt).join(many, ["text", "salt"]).select("id", "nn_id", "score")
    single = found.filter("copies = 1").select(F.col("asked_id").alias("id"), "nn_id", "score")
    return single.union(again).select(F.col("id").alias(id), "nn_id", F.round("score", 6).alias("score"))
