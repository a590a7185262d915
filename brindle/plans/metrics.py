"""Metric queries over the scored embeddings and the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import metrics as M
from brindle.plans.catalog import query
from brindle.plans.scoring import SCORED, scored
from brindle.sources.tables import table

_INSIDE = "i AS (SELECT * FROM s WHERE NOT ood)"


def inside(spark, sf):
    return scored(spark, sf).filter("NOT ood")


@query(f"WITH {SCORED}, {_INSIDE} SELECT round(avg(correct::INT), 6) AS accuracy FROM i")
def accuracy(spark, sf):
    return inside(spark, sf).agg(F.round(M.share(F.col("correct")), 6).alias("accuracy"))


@query(f"WITH {SCORED}, {_INSIDE} SELECT round(avg(a), 6) AS macro_recall FROM (SELECT avg(correct::INT) AS a FROM i GROUP BY gold)")
def macro_recall(spark, sf):
    return inside(spark, sf).groupBy("gold").agg(M.share(F.col("correct")).alias("a")).agg(F.round(F.avg("a"), 6).alias("macro_recall"))


_F1 = "t AS (SELECT label, sum(g * hit) AS tp, sum(p * (1 - hit)) AS fp, sum(g * (1 - hit)) AS fn FROM (SELECT gold AS label, (gold = pred)::INT AS hit, 1 AS g, 0 AS p FROM {0} UNION ALL SELECT pred, (gold = pred)::INT, 0, 1 FROM {0}) GROUP BY label), f AS (SELECT label, tp + fn AS support, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM t)"


@query(f"WITH {SCORED}, {_F1.format('s')} SELECT round(avg(f1), 6) AS macro_f1 FROM f")
def macro_f1(spark, sf):
    return M.per_label(scored(spark, sf)).agg(F.round(F.avg(M.f1()), 6).alias("macro_f1"))


@query(f"WITH {SCORED}, j AS (SELECT gold, CASE WHEN conf < 0.6 THEN -1 ELSE pred END AS pred FROM s), {_F1.format('j')} SELECT round(avg(f1), 6) AS macro_f1 FROM f WHERE support > 0")
def macro_f1_reject(spark, sf):
    rows = scored(spark, sf).withColumn("pred", F.when(F.col("conf") < 0.6, -1).otherwise(F.col("pred")))
    return M.per_label(rows).filter("tp + fn > 0").agg(F.round(F.avg(M.f1()), 6).alias("macro_f1"))


@query(f"WITH {SCORED} SELECT gold, count(*)::BIGINT AS support, round(avg(correct::INT), 6) AS acc_a, round(avg((conf >= 0.6 AND correct)::INT), 6) AS acc_b, round(100 * (avg((conf >= 0.6 AND correct)::INT) - avg(correct::INT)), 6) AS delta_pp FROM s GROUP BY gold")
def per_intent_compare(spark, sf):
    a, b = M.share(F.col("correct")), M.share(F.col("correct") & (F.col("conf") >= 0.6))
    g = scored(spark, sf).groupBy("gold").agg(F.count("*").alias("support"), a.alias("acc_a"), b.alias("acc_b"))
    return M.rounded(g.withColumn("delta_pp", 100 * (F.col("acc_b") - F.col("acc_a"))), "acc_a", "acc_b", "delta_pp")


@query(f"WITH {SCORED} SELECT gold, pred, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def confusion_matrix(spark, sf):
    return scored(spark, sf).groupBy("gold", "pred").agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT gold, pred, count(*)::BIGINT AS n FROM s WHERE NOT correct GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 10")
def confusion_pairs_topk(spark, sf):
    return scored(spark, sf).filter("NOT correct").groupBy("gold", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(10)


_CATEGORY = "CASE WHEN ood AND conf >= 0.6 THEN 'ood_accepted' WHEN ood THEN 'ood_rejected' WHEN correct AND conf >= 0.6 THEN 'right' WHEN correct THEN 'false_rejection' WHEN margin < 0.2 THEN 'close_call' WHEN conf >= 0.9 THEN 'confident_wrong' ELSE 'wrong' END"


@query(f"WITH {SCORED} SELECT vec_id, {_CATEGORY} AS category FROM s")
def cat_error(spark, sf):
    return scored(spark, sf).select("vec_id", F.expr(_CATEGORY).alias("category"))


@query(f"WITH {SCORED}, c AS (SELECT gold, {_CATEGORY} AS category FROM s) SELECT gold, " + ", ".join(f"count(*) FILTER (category = '{c}')::BIGINT AS {c}" for c in ("right", "wrong", "false_rejection", "close_call")) + " FROM c GROUP BY gold")
def error_summary_pivot(spark, sf):
    kinds = ["right", "wrong", "false_rejection", "close_call"]
    rows = scored(spark, sf).select("gold", F.expr(_CATEGORY).alias("category"))
    return rows.groupBy("gold").pivot("category", kinds).count().fillna(0, kinds)


@query(f"WITH {SCORED}, c AS (SELECT gold, pred, CASE WHEN gold < 4 AND pred < 4 THEN 'low' WHEN gold >= 4 AND pred >= 4 THEN 'high' ELSE 'cross' END AS cluster FROM s WHERE NOT correct) SELECT cluster, count(*)::BIGINT AS n FROM c GROUP BY cluster")
def error_clusters(spark, sf):
    low, high = (F.col("gold") < 4) & (F.col("pred") < 4), (F.col("gold") >= 4) & (F.col("pred") >= 4)
    cluster = F.when(low, "low").when(high, "high").otherwise("cross")
    return scored(spark, sf).filter("NOT correct").groupBy(cluster.alias("cluster")).agg(F.count("*").alias("n"))


def _sql_edge(bins: int, first_closed: bool = False, last: str = "1.0") -> str:
    below = "(" + " + ".join(f"(conf > {i / bins!r}::DOUBLE)::INT" for i in range(bins)) + " - 1)"
    return f"CASE WHEN conf <= {last}::DOUBLE THEN {f'greatest({below}, 0)' if first_closed else f'nullif({below}, -1)'} END"


def _ece_query(name: str, bins: int, sql_bin: str, make_bin) -> None:
    @query(f"WITH {SCORED}, b AS (SELECT {sql_bin} AS bin, correct, conf FROM s), g AS (SELECT count(*) AS n, avg(correct::INT) AS a, avg(conf) AS c FROM b WHERE bin IS NOT NULL GROUP BY bin) SELECT round(sum(n * abs(a - c)) / (SELECT count(*) FROM s), 6) AS ece FROM g", name=name)
    def run(spark, sf):
        return M.rounded(M.ece(scored(spark, sf), bins, make_bin()), "ece")


_conf = lambda: F.col("conf")
_ece_query("ece_10_open", 10, _sql_edge(10), lambda: M.edge_bin(_conf(), 10))
_ece_query("ece_10_closed", 10, _sql_edge(10, True), lambda: M.edge_bin(_conf(), 10, True))
_ece_query("ece_12", 12, _sql_edge(12), lambda: M.edge_bin(_conf(), 12))
_ece_query("ece_15_firstclosed", 15, _sql_edge(15, True), lambda: M.edge_bin(_conf(), 15, True))
_ece_query("ece_15_eps", 15, _sql_edge(15, False, "1.000000001"), lambda: M.edge_bin(_conf(), 15, False, 1.000000001))
_ece_query("ece_15_floor", 15, "least(floor(conf * 15::DOUBLE), 14)::INT", lambda: F.least(F.floor(F.col("conf") * 15.0), F.lit(14)))


@query(f"WITH {SCORED}, b AS (SELECT {_sql_edge(10, True)} AS bin, correct, conf FROM s) SELECT r.bin::INT AS bin, count(b.bin)::BIGINT AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(conf), 6) AS confidence FROM range(10) r(bin) LEFT JOIN b USING (bin) GROUP BY r.bin")
def reliability(spark, sf):
    bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    found = M.calibration(scored(spark, sf), 10, M.edge_bin(F.col("conf"), 10, True))
    return M.rounded(bins.join(found, "bin", "left").fillna(0, ["n"]), "accuracy", "confidence")


@query(f"WITH {SCORED}, b AS (SELECT {_sql_edge(10, True)} AS bin, correct, conf FROM s), g AS (SELECT avg(correct::INT) - avg(conf) AS gap FROM b GROUP BY bin HAVING count(*) >= 10) SELECT round(max(abs(gap)), 6) AS mce FROM g")
def mce(spark, sf):
    g = M.calibration(scored(spark, sf), 10, M.edge_bin(F.col("conf"), 10, True)).filter("n >= 10")
    return g.agg(F.round(F.max(F.abs(F.col("accuracy") - F.col("confidence"))), 6).alias("mce"))


@query(f"WITH {SCORED} SELECT round(avg(b), 6) AS brier FROM (SELECT sum((p - (label = gold)::INT) ** 2) AS b FROM p WHERE gold < 8 GROUP BY vec_id)")
def brier(spark, sf):
    parts = F.zip_with("p", "z", lambda p, z: F.pow(p - (z["label"] == F.col("gold")).cast("int"), F.lit(2)))
    return inside(spark, sf).agg(F.round(F.avg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)), 6).alias("brier"))


@query(f"WITH {SCORED} SELECT round(avg(-ln(greatest(p, 1e-12))), 6) AS nll FROM p WHERE label = gold")
def nll(spark, sf):
    p = F.element_at("p", (F.col("gold") + 1).cast("int"))
    return inside(spark, sf).agg(F.round(F.avg(-F.ln(F.greatest(p, F.lit(1e-12)))), 6).alias("nll"))


@query(f"WITH {SCORED}, k AS (SELECT ood, rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2 AS r FROM s) SELECT round((sum(r) FILTER (NOT ood) - count(*) FILTER (NOT ood) * (count(*) FILTER (NOT ood) + 1) / 2) / (count(*) FILTER (NOT ood) * count(*) FILTER (ood)), 6) AS auroc FROM k")
def auroc_rank(spark, sf):
    r = M.average_rank(scored(spark, sf), "conf")
    pos, neg = F.count_if(~F.col("ood")), F.count_if(F.col("ood"))
    return r.agg(F.round((F.sum(F.when(~F.col("ood"), F.col("rank"))) - pos * (pos + 1) / 2) / (pos * neg), 6).alias("auroc"))


@query(f"WITH {SCORED}, g AS (SELECT gold, count(*)::DOUBLE AS n, avg(correct::INT) AS p FROM s GROUP BY gold) SELECT gold, round(1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96::DOUBLE / (4 * n * n)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / n), 6) AS half FROM g")
def wilson_halfwidth(spark, sf):
    g = scored(spark, sf).groupBy("gold").agg(F.count("*").cast("double").alias("n"), M.share(F.col("correct")).alias("p"))
    return g.select("gold", F.round(M.wilson_halfwidth(F.col("p"), F.col("n")), 6).alias("half"))


@query(f"WITH {SCORED}, g AS (SELECT *, conf >= 0.6 AND margin >= 0.2 AS ok FROM s) SELECT round(avg(ok::INT), 6) AS coverage, round(avg(correct::INT) FILTER (ok), 6) AS accepted_precision, round(avg((NOT ok)::INT) FILTER (correct), 6) AS false_rejection, round(avg((ok AND NOT correct)::INT), 6) AS false_execution FROM g")
def gated_stats(spark, sf):
    ok, right = (F.col("conf") >= 0.6) & (F.col("margin") >= 0.2), F.col("correct")
    s = scored(spark, sf).agg(M.share(ok).alias("coverage"), F.avg(F.when(ok, right.cast("int"))).alias("accepted_precision"), F.avg(F.when(right, (~ok).cast("int"))).alias("false_rejection"), M.share(ok & ~right).alias("false_execution"))
    return M.rounded(s, *s.columns)


@query(f"WITH {SCORED} SELECT gold AS family, round(avg((conf < 0.6)::INT), 6) AS rejected FROM s WHERE ood GROUP BY gold")
def ood_rejection(spark, sf):
    return scored(spark, sf).filter("ood").groupBy(F.col("gold").alias("family")).agg(F.round(M.share(F.col("conf") < 0.6), 6).alias("rejected"))


@query(f"WITH {SCORED}, pairs AS (SELECT gold, vec_id // 2 AS pair, bool_and(correct) AS both_ok FROM s GROUP BY ALL HAVING count(*) = 2) SELECT gold AS axis, count(*)::BIGINT AS pairs, round(avg(both_ok::INT), 6) AS both_right FROM pairs GROUP BY gold")
def pair_both_correct(spark, sf):
    p = scored(spark, sf).groupBy("gold", F.floor(F.col("vec_id") / 2).alias("pair")).agg(F.bool_and("correct").alias("both"), F.count("*").alias("n")).filter("n = 2")
    return p.groupBy(F.col("gold").alias("axis")).agg(F.count("*").alias("pairs"), F.round(M.share(F.col("both")), 6).alias("both_right"))


@query(f"WITH {SCORED} SELECT round(coalesce(avg((conf < 0.6)::INT) FILTER (ood), 1.0), 6) AS oos_recall FROM s")
def oos_recall(spark, sf):
    return scored(spark, sf).agg(F.round(F.coalesce(F.avg(F.when(F.col("ood"), (F.col("conf") < 0.6).cast("int"))), F.lit(1.0)), 6).alias("oos_recall"))


@query(f"WITH {SCORED} SELECT pred, count(*)::BIGINT AS fired, count(*) FILTER (NOT correct)::BIGINT AS wrong, count(*) FILTER (NOT correct) <= 5 AS in_budget FROM s WHERE conf >= 0.7 AND pred < 4 GROUP BY pred")
def wrong_action_counts(spark, sf):
    fired = scored(spark, sf).filter((F.col("conf") >= 0.7) & (F.col("pred") < 4))
    wrong = F.count_if(~F.col("correct"))
    return fired.groupBy("pred").agg(F.count("*").alias("fired"), wrong.alias("wrong"), (wrong <= 5).alias("in_budget"))


_OUTCOME = "CASE WHEN conf >= 0.7 AND pred < 4 THEN 'FULFILL' WHEN conf >= 0.7 THEN 'PROMPT' WHEN conf >= 0.4 THEN 'CONFIRM' ELSE 'FALLBACK' END"


@query(f"WITH {SCORED} SELECT {_OUTCOME} AS outcome, count(*)::BIGINT AS n, count(*) FILTER (correct)::BIGINT AS n_right FROM s GROUP BY outcome")
def turn_outcome_counts(spark, sf):
    return scored(spark, sf).groupBy(F.expr(_OUTCOME).alias("outcome")).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_right"))


_SEEDS = "(SELECT event_type AS model, user_id % 5 AS seed, avg(value) AS v FROM events GROUP BY ALL)"


def seeds(spark, sf):
    """(model, seed, v): a figure for each run of a model; the types of events are the models, their users the seeds."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("v"))


@query(f"SELECT model, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, count(*)::BIGINT AS n FROM {_SEEDS} GROUP BY model")
def seed_summary(spark, sf):
    g = seeds(spark, sf).groupBy("model")
    return g.agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("sd"), F.count("*").alias("n"))


@query(f"SELECT model, metric, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS most FROM (SELECT model, unnest(['v', 'miss']) AS metric, unnest([v, 1 - v]) AS v FROM {_SEEDS}) GROUP BY ALL")
def variance_summary(spark, sf):
    rows = seeds(spark, sf).withColumn("miss", 1 - F.col("v"))
    long = rows.unpivot("model", ["v", "miss"], "metric", "x")
    return M.rounded(long.groupBy("model", "metric").agg(F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most")), "mean", "least", "most")


@query("SELECT seed FROM (SELECT user_id % 7 AS seed, round(abs(avg(value) - 20), 9) AS ece, count(*) AS coverage FROM events GROUP BY ALL) WHERE coverage >= 10 ORDER BY ece, coverage DESC, seed LIMIT 1")
def seed_pick(spark, sf):
    """The run with the least error among those that cover enough."""
    runs = table(spark, sf, "events").groupBy((F.col("user_id") % 7).alias("seed")).agg(F.round(F.abs(F.avg("value") - 20), 9).alias("ece"), F.count("*").alias("coverage"))
    return runs.filter("coverage >= 10").orderBy("ece", F.desc("coverage"), "seed").limit(1).select("seed")


@query(f"WITH {SCORED}, b AS (SELECT vec_id, gold, correct AS a_right, (conf >= 0.6 AND correct) AS b_right FROM s) SELECT CASE WHEN a_right AND b_right THEN 'both' WHEN a_right THEN 'broken' WHEN b_right THEN 'fixed' ELSE 'neither' END AS outcome, count(*)::BIGINT AS n FROM b GROUP BY outcome")
def paired_models(spark, sf):
    a = scored(spark, sf).select("vec_id", F.col("correct").alias("a_right"))
    b = scored(spark, sf).select("vec_id", (F.col("correct") & (F.col("conf") >= 0.6)).alias("b_right"))
    outcome = F.when(F.col("a_right") & F.col("b_right"), "both").when(F.col("a_right"), "broken").when(F.col("b_right"), "fixed").otherwise("neither")
    return a.join(b, "vec_id").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT vec_id, pred, runner_up FROM s WHERE (conf >= 0.5) <> (conf >= 0.52)")
def parity_mismatch(spark, sf):
    a = scored(spark, sf).select("vec_id", "pred", "runner_up", (F.col("conf") >= 0.5).alias("gate_a"))
    b = scored(spark, sf).select("vec_id", (F.col("conf") >= 0.52).alias("gate_b"))
    return a.join(b, "vec_id").filter("gate_a <> gate_b").select("vec_id", "pred", "runner_up")


_BUCKET = "least(greatest(value / 500::DOUBLE, 0), 0.9999::DOUBLE)"
_LABELLED = "printf('%.1f-%.1f', floor({0} / 0.1::DOUBLE) * 0.1::DOUBLE, floor({0} / 0.1::DOUBLE) * 0.1::DOUBLE + 0.1::DOUBLE)".format(_BUCKET)


def bucket(conf):
    low = F.floor(F.least(F.greatest(conf, F.lit(0.0)), F.lit(0.9999)) / F.lit(0.1)) * F.lit(0.1)
    return F.format_string("%.1f-%.1f", low, low + F.lit(0.1))


@query(f"SELECT event_id, {_LABELLED} AS bucket FROM events WHERE value IS NOT NULL")
def confidence_bucket(spark, sf):
    return table(spark, sf, "events").filter("value IS NOT NULL").select("event_id", bucket(F.col("value") / 500.0).alias("bucket"))


_DAY = f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, {_LABELLED} AS bucket, count(*)::BIGINT AS n FROM events GROUP BY ALL"


@query(_DAY)
def telemetry_counters(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", bucket(F.col("value") / 500.0).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, {_LABELLED} AS bucket, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def unknown_counters(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), bucket(F.col("value") / 500.0).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT event_id, lower(split_part(event_type, '_', 1)) AS domain FROM events")
def domain_of(spark, sf):
    return table(spark, sf, "events").select("event_id", F.lower(F.coalesce(F.get(F.split("event_type", "[._ ]"), F.lit(0)), F.lit("none"))).alias("domain"))
