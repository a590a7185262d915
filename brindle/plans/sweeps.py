"""Threshold sweeps and decision policies over the scored embeddings.

Thresholds are steps of 1/200 of confidence (column k) and 1/20 of margin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import sweeps as W
from brindle.plans.catalog import query
from brindle.plans.scoring import MODEL, SCORED, scored, vectors
from brindle.operators import scoring as S
from brindle.operators.metrics import rounded

STEPS = list(range(60, 184, 4))
_H = "h AS (SELECT c, m, pred, gold, ood, correct, count(*) AS n FROM s GROUP BY ALL)"
_K = "k(k) AS (SELECT unnest(range(60, 184, 4)))"


def cells(spark, sf):
    return W.histogram(scored(spark, sf), "pred", "gold", "ood", "correct")


def _count(cond: str) -> str:
    return f"coalesce(sum(n) FILTER ({cond}), 0)"


def _swept(spark, sf, points=None, **measures):
    return W.swept(cells(spark, sf), W.grid(spark, k=STEPS) if points is None else points, **{name: F.expr(cond) for name, cond in measures.items()})


def _sql(select: str, tail: str = "", **measures: str) -> str:
    counts = ", ".join(f"{_count(cond)} AS {name}" for name, cond in measures.items())
    return f"WITH {SCORED}, {_H}, {_K}, g AS (SELECT k, {counts} FROM h, k GROUP BY k) SELECT {select} FROM g {tail}"


_T = [0.05, 0.1, 0.2, 0.5, 1.0]


@query("WITH " + MODEL + f", t AS (SELECT unnest({_T}::DOUBLE[]) AS t), x AS (SELECT t, gold, label, vec_id, exp((z - max(z) OVER (PARTITION BY t, vec_id)) / t) AS x FROM z, t WHERE gold < 8), p AS (SELECT *, x / sum(x) OVER (PARTITION BY t, vec_id) AS p FROM x), n AS (SELECT t, round(avg(-ln(greatest(p, 1e-12))), 6) AS nll FROM p WHERE label = gold GROUP BY t) SELECT t, nll FROM n ORDER BY nll, t LIMIT 1")
def fit_temperature(spark, sf):
    rows = scored(spark, sf).filter("NOT ood")
    z = F.transform("z", lambda s: s["z"])
    losses = [F.avg(-F.ln(F.greatest(F.element_at(S.softmax(z, t), (F.col("gold") + 1).cast("int")), F.lit(1e-12)))) for t in _T]
    one = rows.agg(F.array(*(F.struct(F.lit(t).alias("t"), F.round(x, 6).alias("nll")) for t, x in zip(_T, losses, strict=True))).alias("all"))
    return W.best(one.select(F.explode("all").alias("x")).select("x.*"), F.col("nll"), F.col("t"))


@query(f"""WITH {SCORED}, {_H}, {_K}, t AS (SELECT k, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT k, gold AS label, n * (correct AND c >= k)::INT AS tp, 0 AS fp, n * (NOT (correct AND c >= k))::INT AS fn FROM h, k UNION ALL SELECT k, pred, 0, n * (NOT correct)::INT, 0 FROM h, k WHERE c >= k) GROUP BY ALL)
SELECT k, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM t WHERE tp + fn > 0 GROUP BY k""")
def sweep_conf_macro_f1(spark, sf):
    joined = cells(spark, sf).crossJoin(F.broadcast(W.grid(spark, k=STEPS)))
    hit, fired = F.expr("correct AND c >= k"), F.expr("c >= k")
    sides = F.array(
        F.struct(F.col("gold").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(fired & ~F.col("correct"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    t = joined.select("k", F.explode(sides).alias("x")).select("k", "x.*").groupBy("k", "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return t.filter("tp + fn > 0").groupBy("k").agg(F.round(F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))), 6).alias("macro_f1"))


_BAND = {"caught": "NOT correct AND c < k", "asked": "correct AND c < k", "n_right": "correct"}


@query(_sql("k, caught::BIGINT AS caught, round(asked / greatest(n_right, 1), 6) AS friction", "WHERE asked / greatest(n_right, 1) <= 0.10 ORDER BY caught DESC, k LIMIT 1", **_BAND))
def sweep_confirm_band(spark, sf):
    g = _swept(spark, sf, **_BAND).withColumn("friction", F.col("asked") / F.greatest("n_right", F.lit(1)))
    return rounded(W.best(g.filter("friction <= 0.10"), F.desc("caught"), F.col("k")).select("k", "caught", "friction"), "friction")


_LADDER = {"wrong_fire": "c >= fire AND NOT correct", "friction": "c >= floor AND c < fire AND correct", "useful": "c >= floor AND c < fire AND NOT correct", "lost": "c < floor AND NOT ood"}


@query(f"""WITH {SCORED}, {_H}, pts AS (SELECT a.k AS fire, b.k AS floor FROM (SELECT unnest(range(60, 184, 4)) AS k) a, (SELECT unnest(range(60, 184, 4)) AS k) b WHERE b.k < a.k), w(w_wrong, w_ask, w_lost) AS (VALUES (10, 1, 3), (5, 1, 3), (20, 1, 3), (10, 2, 3), (10, 1, 6)),
g AS (SELECT fire, floor, {", ".join(f"{_count(c)} AS {n}" for n, c in _LADDER.items())} FROM h, pts GROUP BY ALL)
SELECT w_wrong, w_ask, w_lost, fire, floor, (w_wrong * wrong_fire + w_ask * friction + w_lost * lost)::BIGINT AS cost FROM g, w QUALIFY row_number() OVER (PARTITION BY w_wrong, w_ask, w_lost ORDER BY cost, fire, floor) = 1""")
def sweep_ladder(spark, sf):
    points = W.grid(spark, fire=STEPS, floor=STEPS).filter("floor < fire")
    g = _swept(spark, sf, points, **_LADDER)
    costs = [(10, 1, 3), (5, 1, 3), (20, 1, 3), (10, 2, 3), (10, 1, 6)]
    w = spark.createDataFrame(costs, "w_wrong int, w_ask int, w_lost int")
    cost = F.col("w_wrong") * F.col("wrong_fire") + F.col("w_ask") * F.col("friction") + F.col("w_lost") * F.col("lost")
    least = F.min(F.struct(cost.alias("cost"), "fire", "floor")).alias("x")
    return g.crossJoin(F.broadcast(w)).groupBy("w_wrong", "w_ask", "w_lost").agg(least).select("w_wrong", "w_ask", "w_lost", "x.fire", "x.floor", "x.cost")


@query(f"WITH {SCORED}, a AS (SELECT vec_id, pred, conf, CASE WHEN vec_id % 5 = 0 THEN runner_up WHEN vec_id % 5 = 1 THEN pred END AS rule FROM s) SELECT vec_id, coalesce(rule, pred) AS pred, round(CASE WHEN rule <> pred THEN 0.60 ELSE conf END, 6) AS conf, CASE WHEN rule IS NULL THEN 'model' WHEN rule = pred THEN 'corroborated' ELSE 'contested' END AS kind FROM a")
def arbitrate(spark, sf):
    rule = F.when(F.col("vec_id") % 5 == 0, F.col("runner_up")).when(F.col("vec_id") % 5 == 1, F.col("pred"))
    a = scored(spark, sf).withColumn("rule", rule)
    contested = F.col("rule") != F.col("pred")
    kind = F.when(F.col("rule").isNull(), "model").when(contested, "contested").otherwise("corroborated")
    return a.select("vec_id", F.coalesce("rule", "pred").alias("pred"), F.round(F.when(contested, 0.60).otherwise(F.col("conf")), 6).alias("conf"), kind.alias("kind"))


_OOV = {"leak": "ood AND m >= r AND c >= k", "wrong": "NOT ood AND NOT correct AND c >= k AND m >= r", "lost": "correct AND (c < k OR m < r)"}


@query(f"""WITH {SCORED}, {_H}, pts AS (SELECT k, r FROM (SELECT unnest(range(60, 184, 4)) AS k), (SELECT unnest(range(0, 10)) AS r)), g AS (SELECT k, r, {", ".join(f"{_count(c)} AS {n}" for n, c in _OOV.items())} FROM h, pts GROUP BY ALL)
SELECT k, r, (10 * (leak + wrong) + 3 * lost)::BIGINT AS cost FROM g ORDER BY cost, k, r LIMIT 1""")
def sweep_oov_guard(spark, sf):
    g = _swept(spark, sf, W.grid(spark, k=STEPS, r=list(range(10))), **_OOV)
    return W.best(g.select("k", "r", (10 * (F.col("leak") + F.col("wrong")) + 3 * F.col("lost")).alias("cost")), F.col("cost"), F.col("k"), F.col("r"))


_RANGE = {"kept": "correct AND c >= k", "rights": "correct", "fired": "c >= k", "total": "TRUE"}


@query(_sql("min(k)::INT AS low, max(k)::INT AS high, (round((min(k) + max(k)) / 8) * 4)::INT AS mid", "WHERE kept >= 0.95 * rights AND fired <= 0.99 * total", **_RANGE))
def sweep_slot_range(spark, sf):
    g = _swept(spark, sf, **_RANGE).filter("kept >= 0.95 * rights AND fired <= 0.99 * total")
    return g.agg(F.min("k").alias("low"), F.max("k").alias("high"), (F.round((F.min("k") + F.max("k")) / 8) * 4).cast("int").alias("mid"))


_INTERRUPT = {"leaks": "ood AND pred < 2 AND c >= k", "admitted": "correct AND c >= k", "rights": "correct"}


@query(_sql("k, admitted::BIGINT AS admitted", "WHERE leaks = (SELECT min(leaks) FROM g) AND admitted >= 0.5 * rights ORDER BY k DESC LIMIT 1", **_INTERRUPT))
def sweep_interrupt(spark, sf):
    g = _swept(spark, sf, **_INTERRUPT)
    least = g.agg(F.min("leaks").alias("least"))
    ok = g.crossJoin(F.broadcast(least)).filter("leaks = least AND admitted >= 0.5 * rights")
    return W.best(ok.select("k", "admitted"), F.desc("k"))


_POINT = {"accepted": "c >= k AND m >= r", "hits": "c >= k AND m >= r AND correct", "total": "TRUE"}
_POINTS = f"""WITH {SCORED}, {_H}, pts AS (SELECT k, r FROM (SELECT unnest(range(40, 200)) AS k), (SELECT unnest([0, 1, 2, 3, 4, 6, 8]) AS r)), g AS (SELECT k, r, {", ".join(f"{_count(c)} AS {n}" for n, c in _POINT.items())} FROM h, pts GROUP BY ALL),
a AS (SELECT *, round(hits / accepted, 9) AS prec, round(accepted / total, 9) AS cov FROM g WHERE accepted > 0)"""


@query(_POINTS + " SELECT k, r, round(prec, 6) AS prec, round(cov, 6) AS cov FROM a WHERE prec >= 0.97 AND cov >= 0.3 ORDER BY cov DESC, r, k LIMIT 1")
def operating_point_2d(spark, sf):
    g = _swept(spark, sf, W.grid(spark, k=list(range(40, 200)), r=[0, 1, 2, 3, 4, 6, 8]), **_POINT).filter("accepted > 0")
    a = g.select("k", "r", F.round(F.col("hits") / F.col("accepted"), 9).alias("prec"), F.round(F.col("accepted") / F.col("total"), 9).alias("cov"))
    return rounded(W.best(a.filter("prec >= 0.97 AND cov >= 0.3"), F.desc("cov"), F.col("r"), F.col("k")), "prec", "cov")


_POINT3 = {"accepted": "c >= k AND m >= r AND NOT ood", "hits": "c >= k AND m >= r AND correct", "leaks": "ood AND c >= k AND m >= r", "oods": "ood", "ins": "NOT ood"}


@query(f"""WITH {SCORED}, {_H}, pts AS (SELECT k, r FROM (SELECT unnest(range(60, 184, 4)) AS k), (SELECT unnest([0, 2, 4, 8]) AS r)), g AS (SELECT k, r, {", ".join(f"{_count(c)} AS {n}" for n, c in _POINT3.items())} FROM h, pts GROUP BY ALL),
a AS (SELECT k, r, round(hits / nullif(accepted, 0), 9) AS prec, round(accepted / ins, 9) AS cov, round(leaks / oods, 9) AS leak FROM g)
SELECT k, r, round(prec, 6) AS prec, round(cov, 6) AS cov, round(leak, 6) AS leak, CASE WHEN prec >= 0.97 AND leak <= 0.1 THEN 0 WHEN prec >= 0.97 THEN 1 ELSE 2 END AS stage FROM a WHERE prec IS NOT NULL ORDER BY stage, cov DESC, leak, k, r LIMIT 1""")
def operating_point_3d(spark, sf):
    g = _swept(spark, sf, W.grid(spark, k=STEPS, r=[0, 2, 4, 8]), **_POINT3)
    a = g.select("k", "r", F.round(F.col("hits") / F.expr("nullif(accepted, 0)"), 9).alias("prec"), F.round(F.col("accepted") / F.col("ins"), 9).alias("cov"), F.round(F.col("leaks") / F.col("oods"), 9).alias("leak")).filter("prec IS NOT NULL")
    a = a.withColumn("stage", F.expr("CASE WHEN prec >= 0.97 AND leak <= 0.1 THEN 0 WHEN prec >= 0.97 THEN 1 ELSE 2 END"))
    return rounded(W.best(a, F.col("stage"), F.desc("cov"), F.col("leak"), F.col("k"), F.col("r")), "prec", "cov", "leak")


@query(f"""WITH {SCORED}, h AS (SELECT c, pred < 2 AS high, correct, count(*) AS n FROM s GROUP BY ALL), {_K}, g AS (SELECT high, k, sum(n) FILTER (c >= k) AS fired, sum(n) FILTER (c >= k AND correct) AS hits FROM h, k GROUP BY ALL),
t AS (SELECT high, min(k) FILTER (hits >= CASE WHEN high THEN 0.99 ELSE 0.95 END * fired) AS k FROM g GROUP BY high) SELECT CASE WHEN high THEN 'high' ELSE 'normal' END AS tier, coalesce(CASE WHEN high THEN greatest(k, (SELECT k FROM t WHERE NOT high)) ELSE k END, 199)::INT AS k FROM t""")
def risk_tier_thresholds(spark, sf):
    h = scored(spark, sf).groupBy("c", (F.col("pred") < 2).alias("high"), "correct").agg(F.count("*").alias("n"))
    j = h.crossJoin(F.broadcast(W.grid(spark, k=STEPS))).filter("c >= k")
    g = j.groupBy("high", "k").agg(F.sum("n").alias("fired"), F.sum(F.when(F.col("correct"), F.col("n")).otherwise(0)).alias("hits"))
    reached = F.col("hits") >= F.when(F.col("high"), 0.99).otherwise(0.95) * F.col("fired")
    t = g.groupBy("high").agg(F.min(F.when(reached, F.col("k"))).alias("k"))
    floor = t.filter("NOT high").select(F.col("k").alias("floor"))
    k = F.coalesce(F.when(F.col("high"), F.greatest("k", "floor")).otherwise(F.col("k")), F.lit(199)).cast("int")
    return t.crossJoin(F.broadcast(floor)).select(F.when(F.col("high"), "high").otherwise("normal").alias("tier"), k.alias("k"))


_CURVE = {"n": "c >= k", "hits": "c >= k AND correct", "total": "TRUE"}


@query(_sql("k, n::BIGINT AS accepted, round(n / total, 6) AS coverage, round(hits / n, 6) AS prec", "WHERE n > 0", **_CURVE).replace("n / total", "acc / total").replace("hits / n,", "hits / acc,").replace("SELECT k, n::BIGINT AS accepted", "SELECT k, acc::BIGINT AS accepted").replace("WHERE n > 0", "WHERE acc > 0").replace("0) AS n,", "0) AS acc,"))
def coverage_precision_curve(spark, sf):
    g = _swept(spark, sf, accepted="c >= k", hits="c >= k AND correct", total="TRUE").filter("accepted > 0")
    return g.select("k", "accepted", F.round(F.col("accepted") / F.col("total"), 6).alias("coverage"), F.round(F.col("hits") / F.col("accepted"), 6).alias("prec"))


_YOUDEN = {"kept": "NOT ood AND c >= k", "ins": "NOT ood", "let": "ood AND c >= k", "oods": "ood"}


@query(_sql("k, round(kept / ins - let / oods, 6) AS j", "WHERE kept >= 0.95 * ins ORDER BY round(kept / ins - let / oods, 9) DESC, k LIMIT 1", **_YOUDEN))
def youden_threshold(spark, sf):
    g = _swept(spark, sf, **_YOUDEN).filter("kept >= 0.95 * ins").select("k", F.round(F.col("kept") / F.col("ins") - F.col("let") / F.col("oods"), 9).alias("j"))
    return rounded(W.best(g, F.desc("j"), F.col("k")), "j")


@query(_sql("k, round(1 - let / oods, 6) AS blocked", "WHERE ins - kept <= 0.02 * ins AND oods >= 25 AND ins >= 25 ORDER BY let, k LIMIT 1", **_YOUDEN))
def asr_threshold(spark, sf):
    g = _swept(spark, sf, **_YOUDEN).filter("ins - kept <= 0.02 * ins AND oods >= 25 AND ins >= 25")
    return W.best(g, F.col("let"), F.col("k")).select("k", F.round(1 - F.col("let") / F.col("oods"), 6).alias("blocked"))


_HARM = {"rejected": "ood AND c < k", "oods": "ood", "hits": "correct AND c >= k", "ins": "NOT ood"}
_HARMONIC = "coalesce(2 * (rejected / oods) * (hits / ins) / nullif(rejected / oods + hits / ins, 0), 0)"


@query(_sql(f"k, round({_HARMONIC}, 6) AS score", f"ORDER BY round({_HARMONIC}, 9) DESC, k LIMIT 1", **_HARM))
def harmonic_sweep(spark, sf):
    g = _swept(spark, sf, **_HARM).select("k", F.round(F.expr(_HARMONIC), 9).alias("score"))
    return rounded(W.best(g, F.desc("score"), F.col("k")), "score")


_SAFE = {"fired": "NOT ood AND c >= k", "hits": "correct AND c >= k", "ins": "NOT ood", "rejected": "ood AND c < k", "oods": "ood"}
_SAFETY = "coalesce(hits / nullif(fired, 0), 0) * (fired / ins) * (rejected / oods)"


@query(_sql(f"k, round({_SAFETY}, 6) AS score", **_SAFE))
def safety_score(spark, sf):
    return _swept(spark, sf, **_SAFE).select("k", F.round(F.expr(_SAFETY), 6).alias("score"))


@query(_sql("k, round(kept / ins, 6) AS kept, round(1 - let / oods, 6) AS rejected", **_YOUDEN))
def rejection_curve(spark, sf):
    return _swept(spark, sf, **_YOUDEN).select("k", F.round(F.col("kept") / F.col("ins"), 6).alias("kept"), F.round(1 - F.col("let") / F.col("oods"), 6).alias("rejected"))


@query(f"WITH {SCORED}, tops AS (SELECT vec_id, max(z) AS top FROM z GROUP BY vec_id), j AS (SELECT s.*, floor(top * 20)::INT AS t FROM s JOIN tops USING (vec_id)), k(k) AS (SELECT unnest(range(0, 20))) SELECT k, count(*) FILTER (ood AND t < k)::BIGINT AS blocked_oos, count(*) FILTER (correct AND t < k)::BIGINT AS blocked_right FROM j, k GROUP BY k")
def oos_signal_sweep(spark, sf):
    rows = scored(spark, sf).withColumn("t", F.floor(F.array_max(F.transform("z", lambda s: s["z"])) * 20).cast("int"))
    h = rows.groupBy("t", "ood", "correct").agg(F.count("*").alias("n"))
    return W.swept(h, W.grid(spark, k=list(range(20))), blocked_oos=F.expr("ood AND t < k"), blocked_right=F.expr("correct AND t < k"))


_TAIL = {"wrong": "NOT correct AND c >= k", "n_right": "correct AND c >= k"}


@query(f"WITH {SCORED}, {_H}, {_K} SELECT k, CASE WHEN m >= 10 THEN 'clear' ELSE 'close' END AS stage, {_count('NOT correct AND c >= k')}::BIGINT AS wrong, {_count('correct AND c >= k')}::BIGINT AS n_right FROM h, k GROUP BY ALL")
def tail_wrong_by_stage(spark, sf):
    stage = F.when(F.col("m") >= 10, "clear").otherwise("close")
    h = cells(spark, sf).groupBy("c", stage.alias("stage"), "correct").agg(F.sum("n").alias("n"))
    j = h.crossJoin(F.broadcast(W.grid(spark, k=STEPS)))
    return j.groupBy("k", "stage").agg(*(F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0)).alias(n) for n, c in _TAIL.items()))


@query(_sql("max(k)::INT AS k", "WHERE round(hits / total, 9) >= (SELECT max(round(hits / total, 9)) FROM g) - 0.002", hits="(correct AND c >= k) OR (ood AND c < k)", total="TRUE"))
def threshold_plateau(spark, sf):
    g = _swept(spark, sf, hits="(correct AND c >= k) OR (ood AND c < k)", total="TRUE").withColumn("acc", F.round(F.col("hits") / F.col("total"), 9))
    top = g.agg(F.max("acc").alias("top"))
    return g.crossJoin(F.broadcast(top)).filter("acc >= top - 0.002").agg(F.max("k").alias("k"))


_POLICIES = {
    "s2_only": ("pred", "TRUE"), "replace": ("runner_up", "margin < 0.1"), "backstop": ("pred", "conf >= 0.4"), "max_conf": ("pred", "conf >= 0.5 OR margin >= 0.3"), "dual": ("pred", "conf >= 0.40 AND margin >= 0.30"),
}
_POLICY_SQL = " UNION ALL ".join(f"SELECT '{n}' AS policy, avg(((CASE WHEN {cond} THEN {label} END) IS NOT DISTINCT FROM gold)::INT) FILTER (NOT ood) AS stress, avg((NOT ({cond}))::INT) FILTER (ood) AS rejected FROM s" for n, (label, cond) in _POLICIES.items())


@query(f"WITH {SCORED}, a AS ({_POLICY_SQL}) SELECT policy, round(stress, 6) AS stress, round(rejected, 6) AS rejected, round(coalesce(2 * stress * rejected / nullif(stress + rejected, 0), 0), 6) AS harmonic FROM a")
def policy_compare(spark, sf):
    def measured(label: str, cond: str):
        says = F.when(F.expr(cond), F.col(label))
        stress = F.avg(F.when(~F.col("ood"), says.eqNullSafe(F.col("gold")).cast("int")))
        return stress, F.avg(F.when(F.col("ood"), (~F.expr(cond)).cast("int")))

    all_ = F.array(*(F.struct(F.lit(n).alias("policy"), a.alias("stress"), b.alias("rejected")) for n, (a, b) in ((n, measured(*x)) for n, x in _POLICIES.items())))
    rows = scored(spark, sf).agg(all_.alias("all")).select(F.explode("all").alias("x")).select("x.*")
    return rounded(rows.withColumn("harmonic", F.expr("coalesce(2 * stress * rejected / nullif(stress + rejected, 0), 0)")), "stress", "rejected", "harmonic")


@query()
def scope_gate(spark, sf):
    """A logistic gate on confidence, margin and entropy, and how it separates in-scope rows from others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = scored(spark, sf).select("vec_id", (~F.col("ood")).cast("double").alias("label"), "conf", "margin", "entropy")
    data = VectorAssembler(inputCols=["conf", "margin", "entropy"], outputCol="features").transform(rows)
    model = LogisticRegression(regParam=0.001, maxIter=50).fit(data)
    return model.transform(data).select("vec_id", "label", "prediction")


_GUARDS = {"none": "TRUE", "margin": "margin >= 0.2", "entropy": "entropy <= 1.0", "conf": "conf >= 0.5", "margin_entropy": "margin >= 0.2 AND entropy <= 1.0", "all": "margin >= 0.2 AND entropy <= 1.0 AND conf >= 0.5"}


@query(f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{n}' AS config, count(*) FILTER ({c} AND correct)::BIGINT AS n_right, count(*) FILTER ({c} AND NOT correct)::BIGINT AS wrong, count(*) FILTER (NOT ({c}))::BIGINT AS rejected FROM s" for n, c in _GUARDS.items()))
def guard_ablation(spark, sf):
    row = lambda n, c: F.struct(F.lit(n).alias("config"), F.count_if(F.expr(f"{c} AND correct")).alias("n_right"), F.count_if(F.expr(f"{c} AND NOT correct")).alias("wrong"), F.count_if(F.expr(f"NOT ({c})")).alias("rejected"))
    return scored(spark, sf).agg(F.array(*(row(n, c) for n, c in _GUARDS.items())).alias("all")).select(F.explode("all").alias("x")).select("x.*")
