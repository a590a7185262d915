"""Rule, guard and relabelling queries, over the turns of conversations, the documents and the events.

The tables hold invented prose, in which command words are rare; so every other turn says one of a few fixed
phrases instead of its own text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import rules as R
from brindle.functions import text as X
from brindle.plans import oracle as O
from brindle.plans.catalog import query
from brindle.plans.corpus import docs
from brindle.sources.tables import inline, table, values

TURNS = [
    (1, "Mute"), (2, "turn up the volume please"), (3, "i don't want to translate this"), (4, "translate this for me"), (5, "nothing to translate"), (6, "how do i mute it"), (7, "yes, no worries"), (8, "no"),
    (9, "no, tomorrow at 5"), (10, "maybe yes"), (11, "cancel the reminder"), (12, "yes but no"), (13, "sure thing"), (14, "not the music, the radio"), (15, "i meant the other one"), (16, "lower how loud it is"),
    (17, "make it louder"), (18, "please remind me to call mom"), (19, "set an alarm to get up"), (20, "i need to buy milk tomorrow"), (21, ""), (22, "never stop, translate now"), (23, "remind me"), (24, "make sure i lock the door"),
]
RULES = [
    {"intent": "mute", "exact": ["mute", "be quiet"]},
    {"intent": "translate", "contains": ["translate", "translation"]},
    {"intent": "volume_up", "regex": "(^| )(up|louder)( |$)", "not_regex": "down"},
    {"intent": "remind", "regex": "(^| )remind( |$)"},
]
YES, NO, CANCEL = ("yes", "sure", "ok"), ("no", "nope", "not"), ("cancel", "never mind", "stop")
_T = f"(SELECT conv_id * 1000 + turn AS utt_id, CASE WHEN (conv_id + turn) % 2 = 0 THEN phrase ELSE text END AS text FROM conversations JOIN {values('k, phrase', TURNS)} ON k = (conv_id * 7 + turn) % {len(TURNS)} + 1)"


def turns(spark, sf):
    """(utt_id, text): the turns of all conversations, every other one with a phrase of ``TURNS``."""
    phrases = F.array(*(F.lit(t) for _, t in TURNS))
    phrase = F.get(phrases, ((F.col("conv_id") * 7 + F.col("turn")) % len(TURNS)).cast("int"))
    said = F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, phrase).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt_id"), said.alias("text"))


def sql_word(t: str, cues) -> str:
    return "(" + " OR ".join(f"regexp_matches({t}, {O.quoted(R.word(c))})" for c in cues) + ")"


def sql_negated(t: str, term: str) -> str:
    return f"(instr({t}, {term}) > 0 AND {sql_word(f'right(left({t}, instr({t}, {term}) - 1), 30)', R.NEGATIONS)})"


_FIRES = [
    "lower(text) IN ('mute', 'be quiet')",
    "(" + " OR ".join(f"(contains(lower(text), '{t}') AND NOT {sql_negated('lower(text)', chr(39) + t + chr(39))})" for t in RULES[1]["contains"]) + ")",
    f"(regexp_matches(lower(text), '{RULES[2]['regex']}') AND NOT regexp_matches(lower(text), 'down'))",
    f"regexp_matches(lower(text), '{RULES[3]['regex']}')",
]
_INTENT = "CASE " + " ".join(f"WHEN {f} THEN '{r['intent']}'" for f, r in zip(_FIRES, RULES, strict=True)) + " END"


@query(f"SELECT utt_id FROM {_T} WHERE {_FIRES[0]}")
def kw_exact(spark, sf):
    terms = inline(spark, "term string", [(t,) for t in RULES[0]["exact"]])
    return turns(spark, sf).join(F.broadcast(terms), F.lower("text") == F.col("term"), "left_semi").select("utt_id")


@query(f"SELECT utt_id FROM {_T} WHERE {_FIRES[1]}")
def kw_contains(spark, sf):
    return turns(spark, sf).filter(R.first_rule(F.lower("text"), [RULES[1]]).isNotNull()).select("utt_id")


@query(f"SELECT utt_id FROM {_T} WHERE {_FIRES[2]}")
def kw_regex(spark, sf):
    return turns(spark, sf).filter(R.first_rule(F.lower("text"), [RULES[2]]).isNotNull()).select("utt_id")


@query(f"SELECT utt_id, {_INTENT} AS intent, CASE {_INTENT} WHEN 'mute' THEN 'exact' WHEN 'translate' THEN 'contains' WHEN 'volume_up' THEN 'regex_guarded' WHEN 'remind' THEN 'regex' END AS tier FROM {_T}")
def kw_first_match(spark, sf):
    return turns(spark, sf).withColumn("hit", R.first_rule(F.lower("text"), RULES)).select("utt_id", "hit.intent", "hit.tier")


_NEG = sql_negated("lower(text)", "'the '")


@query(f"SELECT doc_id, {_NEG} AS negated FROM documents")
def negation_window(spark, sf):
    return docs(spark, sf).select("doc_id", R.negated(F.lower("text"), F.lit("the ")).alias("negated"))


_GUARDS = [("(^| )(up|loud|louder)( |$)", "volume_down", "volume_up"), ("(^| )(down|lower|quiet)( |$)", "volume_up", "volume_down")]
_PREDICTED = f"(SELECT utt_id, text, CASE WHEN utt_id % 3 = 0 THEN 'volume_up' WHEN utt_id % 3 = 1 THEN 'volume_down' ELSE 'mute' END AS intent FROM {_T})"


@query(f"""WITH t AS (SELECT utt_id, lower(text) AS text, intent FROM {_PREDICTED}), g AS {values('rx, blocked, redirect', _GUARDS)},
h AS (SELECT t.utt_id, t.intent, g.redirect FROM t JOIN g ON g.blocked = t.intent AND regexp_matches(t.text, g.rx) WHERE NOT EXISTS (SELECT 1 FROM g m WHERE m.blocked = g.redirect AND m.redirect = t.intent AND regexp_matches(t.text, m.rx)))
SELECT t.utt_id, coalesce(CASE WHEN count(h.redirect) = 1 THEN max(h.redirect) END, any_value(t.intent)) AS intent FROM t LEFT JOIN h USING (utt_id) GROUP BY t.utt_id""")
def guard_polarity(spark, sf):
    predicted = F.when(F.col("utt_id") % 3 == 0, "volume_up").when(F.col("utt_id") % 3 == 1, "volume_down").otherwise("mute")
    t = turns(spark, sf).select("utt_id", F.lower("text").alias("text"), predicted.alias("intent"))
    hit = lambda rx: F.col("text").rlike(rx)
    redirects = [F.when((F.col("intent") == b) & hit(rx) & ~R.any_of([(F.col("intent") == r2) & F.lit(b2 == r) & hit(rx2) for rx2, b2, r2 in _GUARDS]), F.lit(r)) for rx, b, r in _GUARDS]
    found = F.filter(F.array(*redirects), F.isnotnull)
    return t.select("utt_id", F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.col("intent")).alias("intent"))


@query(f"SELECT utt_id, CASE WHEN regexp_matches(lower(text), '(^| )(how|guide|what)( |$)') AND {_INTENT} IN ('mute', 'volume_up') THEN 'help_' || {_INTENT} ELSE {_INTENT} END AS intent FROM {_T}")
def guard_help_marker(spark, sf):
    hit = turns(spark, sf).withColumn("intent", R.first_rule(F.lower("text"), RULES)["intent"])
    asks = F.lower("text").rlike("(^| )(how|guide|what)( |$)") & F.col("intent").isin("mute", "volume_up")
    return hit.select("utt_id", F.when(asks, F.concat(F.lit("help_"), F.col("intent"))).otherwise(F.col("intent")).alias("intent"))


@query(f"SELECT utt_id, regexp_matches(lower(text), {O.quoted(R.CORRECTIVE)}) AS corrective FROM {_T}")
def guard_corrective(spark, sf):
    return turns(spark, sf).select("utt_id", F.lower("text").rlike(R.CORRECTIVE).alias("corrective"))


_SCAN = "lower(trim(text))"
for _i in R.NO_IDIOMS:
    _SCAN = f"replace({_SCAN}, '{_i}', ' ')"
_UNSURE = " OR ".join(f"contains(lower(trim(text)), {O.quoted(p)})" for p in R.UNCERTAIN)
_YESNO = f"CASE WHEN {_UNSURE} THEN NULL WHEN {sql_word(_SCAN, NO)} THEN FALSE WHEN {sql_word(_SCAN, YES)} THEN TRUE END"


@query(f"SELECT utt_id, {_YESNO} AS polarity FROM {_T}")
def yes_no_polarity(spark, sf):
    return turns(spark, sf).select("utt_id", R.yes_no(F.col("text"), YES, NO).alias("polarity"))


CANCELS = f"({sql_word('lower(trim(text))', CANCEL)} OR (coalesce(NOT {_YESNO}, FALSE) AND len(regexp_split_to_array(lower(trim(text)), ' +')) <= 2))"


@query(f"SELECT utt_id, {CANCELS} AS cancels FROM {_T}")
def is_cancel(spark, sf):
    return turns(spark, sf).select("utt_id", R.cancels(F.col("text"), CANCEL, YES, NO).alias("cancels"))


_LABELS = [("mute", True, False), ("volume_up", True, False), ("translate", False, True), ("remind", True, False)]


@query(f"SELECT utt_id, coalesce(actionable, FALSE) AS actionable, coalesce(read_only, FALSE) AS read_only FROM (SELECT utt_id, {_INTENT} AS intent FROM {_T}) LEFT JOIN {values('intent, actionable, read_only', _LABELS)} USING (intent)")
def is_actionable(spark, sf):
    hit = turns(spark, sf).select("utt_id", R.first_rule(F.lower("text"), RULES)["intent"].alias("intent"))
    labels = inline(spark, "intent string, actionable boolean, read_only boolean", _LABELS)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return hit.join(F.broadcast(labels), "intent", "left").select("utt_id", flag("actionable"), flag("read_only"))


_CRITICAL = ("secret", "password", "the of", "license")


@query("SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{c}')" for c in _CRITICAL) + " AS critical FROM documents")
def critical_mask(spark, sf):
    phrases = F.array(*map(F.lit, _CRITICAL))
    return docs(spark, sf).select("doc_id", F.exists(phrases, lambda p: F.contains(F.lower("text"), p)).alias("critical"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^| )(volume|radio|secret)( |$)') THEN TRUE WHEN regexp_matches(lower(text), '(^| )(set|the)( |$)') AND NOT contains(lower(text), 'que') THEN TRUE ELSE FALSE END AS hit FROM documents")
def domain_token_hit(spark, sf):
    low = F.lower("text")
    hit = F.when(low.rlike("(^| )(volume|radio|secret)( |$)"), True).when(low.rlike("(^| )(set|the)( |$)") & ~F.contains(low, F.lit("que")), True).otherwise(False)
    return docs(spark, sf).select("doc_id", hit.alias("hit"))


_SIGNATURES = {"en": "(^| )(the|and|with)( |$)", "fr": "(^| )(que|les|des)( |$)", "de": "(^| )(der|und|ist)( |$)", "es": "(^| )(los|una|con)( |$)"}
_SIG = values("sig, rx", list(_SIGNATURES.items()))


@query(f"WITH g AS {_SIG}, h AS (SELECT doc_id, lang, sig FROM documents JOIN g ON regexp_matches(lower(text), rx)) SELECT doc_id, lang, array_to_string(list_sort(list(sig)), ',') AS says FROM h WHERE doc_id NOT IN (SELECT doc_id FROM h WHERE sig = lang) GROUP BY doc_id, lang")
def mislabel_scan(spark, sf):
    low = F.lower("text")
    says = F.array_sort(F.filter(F.array(*(F.when(low.rlike(rx), F.lit(sig)) for sig, rx in _SIGNATURES.items())), F.isnotnull))
    rows = docs(spark, sf).select("doc_id", "lang", says.alias("says"))
    return rows.filter((F.size("says") > 0) & ~F.array_contains("says", F.col("lang"))).select("doc_id", "lang", F.array_join("says", ",").alias("says"))


_CARRIED = "lower(text)"
for _p in R.CARRIERS:
    _CARRIED = f"regexp_replace({_CARRIED}, {O.quoted(_p)}, '')"


@query(f"SELECT utt_id, trim({_CARRIED}) AS topic FROM {_T}")
def carrier_strip(spark, sf):
    return turns(spark, sf).select("utt_id", R.without_carriers(F.col("text")).alias("topic"))


_MAP = [("click", "tap"), ("view", "look"), ("purchase", None)]


@query(f"SELECT event_id, coalesce(new, event_type) AS event_type FROM events LEFT JOIN {values('event_type, new', _MAP)} USING (event_type)")
def relabel_map(spark, sf):
    mapping = inline(spark, "event_type string, new string", _MAP)
    return table(spark, sf, "events").join(F.broadcast(mapping), "event_type", "left").select("event_id", F.coalesce("new", "event_type").alias("event_type"))


_FATE = "CASE WHEN m.event_type IS NULL THEN 'unknown' WHEN new IS NULL THEN 'removed' ELSE 'renamed' END"


@query(f"SELECT {_FATE} AS fate, coalesce(new, e.event_type) AS label, count(*)::BIGINT AS n FROM events e LEFT JOIN {values('event_type, new', _MAP)} m ON e.event_type = m.event_type GROUP BY ALL")
def relabel_migrate(spark, sf):
    mapping = inline(spark, "event_type string, new string", _MAP).withColumn("known", F.lit(True))
    rows = table(spark, sf, "events").join(F.broadcast(mapping), "event_type", "left")
    fate = F.when(F.col("known").isNull(), "unknown").when(F.col("new").isNull(), "removed").otherwise("renamed")
    return rows.groupBy(fate.alias("fate"), F.coalesce("new", "event_type").alias("label")).agg(F.count("*").alias("n"))


_CASCADE = [("(^| )(the|and)( |$)", "english"), ("(^| )(que|les)( |$)", "french"), ("[äöüß]", "german")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{v}'" for p, v in _CASCADE) + " ELSE lang END AS label FROM documents")
def relabel_regex_firstmatch(spark, sf):
    out = F.col("lang")
    for pattern, label in reversed(_CASCADE):
        out = F.when(F.lower("text").rlike(pattern), label).otherwise(out)
    return docs(spark, sf).select("doc_id", out.alias("label"))


@query("SELECT doc_id, CASE WHEN lang = 'es' AND regexp_matches(lower(text), '(^| )(the|and)( |$)') THEN 'en' ELSE lang END AS label FROM documents")
def relabel_oos_fix(spark, sf):
    return docs(spark, sf).select("doc_id", F.when((F.col("lang") == "es") & F.lower("text").rlike("(^| )(the|and)( |$)"), "en").otherwise(F.col("lang")).alias("label"))


@query(f"SELECT utt_id, CASE WHEN p THEN 'send - yes' WHEN NOT p THEN 'send - no' ELSE 'send' END AS label FROM (SELECT utt_id, {_YESNO} AS p FROM {_T})")
def relabel_confirm_compound(spark, sf):
    compound = inline(spark, "intent string, polarity boolean, label string", [("send", True, "send - yes"), ("send", False, "send - no")])
    rows = turns(spark, sf).select("utt_id", F.lit("send").alias("intent"), R.yes_no(F.col("text"), YES, NO).alias("polarity"))
    return rows.join(F.broadcast(compound), ["intent", "polarity"], "left").select("utt_id", F.coalesce("label", "intent").alias("label"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, source || '_' || lang || '.csv' AS file FROM documents), LATERAL (SELECT CASE WHEN contains(file, '_fr') THEN 'fr' WHEN contains(file, '_de') THEN 'de' WHEN contains(file, '_es') THEN 'es' ELSE 'en' END AS lang)")
def lang_of_filename(spark, sf):
    file = F.concat("source", F.lit("_"), "lang", F.lit(".csv"))
    lang = F.when(F.contains(file, F.lit("_fr")), "fr").when(F.contains(file, F.lit("_de")), "de").when(F.contains(file, F.lit("_es")), "es").otherwise("en")
    return docs(spark, sf).select("doc_id", lang.alias("lang"))


_WORDS = ("up", "down", "not", "off", "on")


@query(f"""WITH w AS (SELECT utt_id, {O.words('lower(text)')} AS words FROM {_T}), p AS (SELECT a.utt_id AS a, b.utt_id AS b, list_concat(list_filter(a.words, lambda x: NOT list_contains(b.words, x)), list_filter(b.words, lambda x: NOT list_contains(a.words, x))) AS diff FROM w a JOIN w b ON b.utt_id = a.utt_id + 1)
SELECT a, b, list_has_any(diff, {list(_WORDS)}) AS exempt FROM p""")
def polarity_diff_exempt(spark, sf):
    w = turns(spark, sf).select(F.col("utt_id").alias("a"), X.words(F.lower("text")).alias("x"))
    v = turns(spark, sf).select(F.col("utt_id").alias("b"), X.words(F.lower("text")).alias("y"))
    diff = F.array_union(F.array_except("x", "y"), F.array_except("y", "x"))
    return w.join(v, F.col("b") == F.col("a") + 1).select("a", "b", F.arrays_overlap(diff, F.array(*map(F.lit, _WORDS))).alias("exempt"))


PATTERNS = [
    (1, r"^set (an? )?alarm$"), (2, r"(?=x)a"), (3, r"(?<!x)a"), (4, r"a*?b"), (5, r"(a(b(c(d(e)))))"), (6, r"x{2,40}"), (7, r"\p{L}+"), (8, r"(a)\1"), (9, r"\(\(\(\(\(ok"), (10, r"(?P<n>a)"), (11, "a" * 600), (12, r"a++b{3}?"), (13, r"\012"), (14, r"(?i)x"), (15, r"a{99999999999999999999}"),
]
_P = f"(SELECT p_partkey AS id, p_name || ' ' || v.pattern AS pattern FROM part JOIN {values('k, pattern', PATTERNS)} v ON k = p_partkey % {len(PATTERNS)} + 1)"


def patterns(spark, sf):
    """(id, pattern): each part's name with one of ``PATTERNS`` behind it."""
    tail = F.get(F.array(*(F.lit(p) for _, p in PATTERNS)), (F.col("p_partkey") % len(PATTERNS)).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", tail).alias("pattern"))


_DEPTH = r"list_max(list_prepend(0::BIGINT, list_transform(range(1, length(plain) + 1), lambda i: (length(replace(left(plain, i), ')', '')) - length(replace(replace(left(plain, i), ')', ''), '(', ''))) - (length(replace(left(plain, i), '(', '')) - length(replace(replace(left(plain, i), '(', ''), ')', ''))))))"
_PROBLEMS = ", ".join(f"CASE WHEN regexp_matches(pattern, {O.quoted(p)}) THEN '{n}' END" for p, n in R.FORBIDDEN)


_CHECKED = rf"""WITH p AS (SELECT *, regexp_replace(pattern, '\\.', '', 'g') AS plain FROM {_P}), c AS (
SELECT id, array_to_string(list_sort(list_distinct(list_filter([{_PROBLEMS}, CASE WHEN length(pattern) > 512 THEN 'too long' END, CASE WHEN len(list_filter(regexp_extract_all(pattern, '[{{,](\d+)', 1), lambda n: n::HUGEINT > 32)) > 0 THEN 'bound too large' END, CASE WHEN {_DEPTH} > 4 THEN 'too deep' END], lambda x: x IS NOT NULL))), ', ') AS problems FROM p)"""


@query(f"{_CHECKED} FROM c")
def regex_portability(spark, sf):
    return patterns(spark, sf).select("id", F.array_join(R.portability(F.col("pattern")), ", ").alias("problems"))


@query(f"{_CHECKED} SELECT id FROM c WHERE problems = ''")
def v10_portability(spark, sf):
    return patterns(spark, sf).filter(F.size(R.portability(F.col("pattern"))) == 0).select("id")


@query("WITH s AS (SELECT vec_id, (vec_id * 37 % 100) / 100::DOUBLE AS conf, (vec_id * 53 % 10) / 10::DOUBLE AS ratio FROM embeddings) SELECT vec_id, CASE WHEN ratio >= 0.5::DOUBLE AND conf < 0.9::DOUBLE THEN 'fallback' ELSE 'pass' END AS verdict FROM s")
def guard_oov(spark, sf):
    s = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") * 37 % 100 / 100).alias("conf"), (F.col("vec_id") * 53 % 10 / 10).alias("ratio"))
    return s.select("vec_id", F.when((F.col("ratio") >= 0.5) & (F.col("conf") < 0.9), "fallback").otherwise("pass").alias("verdict"))


def cascade(conf: str = "conf", corroborated: str = "corroborated", ratio: str = "ratio", second_intent: str = "second_intent", second_conf: str = "second_conf", intent: str = "intent", backstop: float = 0.30) -> str:
    """The order of decisions for a turn: guard on unknown words, fire bar, rescue by the second model, backstop."""
    return f"""CASE WHEN {intent} <> 'fallback' AND {conf} < 0.90D AND {ratio} >= 0.50D THEN 'fallback'
 WHEN {intent} <> 'fallback' AND {conf} >= CASE WHEN {corroborated} THEN 0.50D ELSE 0.70D END THEN 'fire'
 WHEN {second_intent} <> 'fallback' AND NOT ({backstop}D > 0 AND {conf} > {second_conf}) AND {second_conf} >= CASE WHEN {second_intent} = {intent} AND {intent} <> 'fallback' THEN 0.50D ELSE 0.40D END THEN 'rescue'
 WHEN {backstop}D > 0 AND {intent} <> 'fallback' AND {conf} >= {backstop}D THEN 'backstop' ELSE 'fallback' END"""


_TRACE = "SELECT vec_id, (vec_id * 37 % 100) / 100.0{d} AS conf, vec_id % 3 = 0 AS corroborated, (vec_id * 53 % 10) / 10.0{d} AS ratio, CASE WHEN vec_id % 4 = 0 THEN 'a' WHEN vec_id % 4 = 1 THEN 'b' ELSE 'fallback' END AS second_intent, (vec_id * 71 % 100) / 100.0{d} AS second_conf, CASE WHEN vec_id % 7 = 0 THEN 'fallback' WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS intent FROM embeddings"


@query(f"SELECT vec_id, intent, {cascade().replace('0D', '0::DOUBLE').replace('0.3D', '0.3::DOUBLE')} AS verdict FROM ({_TRACE.format(d='::DOUBLE')})")
def cascade_decide(spark, sf):
    trace = spark.sql(_TRACE.format(d="D").replace("FROM embeddings", "FROM {e}"), e=table(spark, sf, "embeddings"))
    return trace.select("vec_id", "intent", F.expr(cascade()).alias("verdict"))


@query(f"SELECT vec_id, CASE WHEN verdict = 'fire' AND corroborated THEN 'rule' WHEN verdict = 'fire' THEN 'model' WHEN verdict = 'rescue' THEN 'semantic' ELSE verdict END AS stage FROM (SELECT *, {cascade().replace('0D', '0::DOUBLE').replace('0.3D', '0.3::DOUBLE')} AS verdict FROM ({_TRACE.format(d='::DOUBLE')}))")
def stage_attribution(spark, sf):
    trace = spark.sql(_TRACE.format(d="D").replace("FROM embeddings", "FROM {e}"), e=table(spark, sf, "embeddings")).withColumn("verdict", F.expr(cascade()))
    stage = F.when((F.col("verdict") == "fire") & F.col("corroborated"), "rule").when(F.col("verdict") == "fire", "model").when(F.col("verdict") == "rescue", "semantic").otherwise(F.col("verdict"))
    return trace.select("vec_id", stage.alias("stage"))
