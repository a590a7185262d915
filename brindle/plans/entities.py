"""Entity and date-time queries over the events: each says a fixed phrase, and its own time is ``now``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import entities as E
from brindle.functions import rules as R
from brindle.plans import oracle as O
from brindle.plans.catalog import query
from brindle.plans.corpus import docs
from brindle.plans.rules import _T, sql_word, turns
from brindle.sources.tables import inline, table, values

SAYS = (
    "call mom in 5 minutes", "remind me tomorrow at 8am", "lunch at 1", "meeting on friday at 15:30", "wake me at half past seven", "in a couple of hours", "in half an hour", "yesterday at 5", "july fourth at noon", "on the 25th",
    "next week", "tuesday morning", "quarter to nine tonight", "set twenty alarms", "wait a second", "the fifth of july", "february 30", "in an hour", "this weekend", "twenty past 6 in the evening", "at 9",
    "day after tomorrow at 10 pm", "", "in 2 weeks", "yes please", "no thanks", "call 12345678901", "in 99999999999 minutes", "call 99999999999999999999", "Sunday", "at 12 am", "3 to 4 in the afternoon", "the 31st at 18.45",
)
#: Utterances: the event, its phrase and its time.
_S = f"(SELECT event_id AS utt_id, user_id, ts AS n, said[event_id % {len(SAYS)} + 1] AS text FROM events, (SELECT [{', '.join(map(O.quoted, SAYS))}] AS said))"


def _said(phrases):
    return F.get(F.array(*map(F.lit, phrases)), (F.col("event_id") % len(phrases)).cast("int"))


def says(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("utt_id"), "user_id", F.col("ts").alias("now"), _said(SAYS).alias("text"))


def low():
    return F.lower("text")


def _word_in(t: str, w: str) -> str:
    return f"regexp_matches({t}, '(^|[^a-z0-9])({w})([^a-z0-9]|$)')"


_DIGITS = "regexp_extract(lower(text), '(^|[^a-z0-9_])([0-9]+)([^a-z0-9_]|$)', 2)"
_NUM = f"CASE WHEN {_DIGITS} <> '' THEN try_cast({_DIGITS} AS BIGINT) " + " ".join(f"WHEN {_word_in('lower(text)', w)} THEN {n}" for w, n in E.NUMBERS.items()) + " END"


@query(f"SELECT utt_id, {_NUM} AS n FROM {_S}")
def extract_number(spark, sf):
    return says(spark, sf).select("utt_id", E.number(low()).alias("n"))


def _sql_digits(t: str) -> str:
    for w in sorted(E.CLOCK_NUMBERS, key=len, reverse=True):
        t = rf"regexp_replace({t}, '\b{w}\b', '{E.CLOCK_NUMBERS[w]}', 'g')"
    return t


def _sql_ordinals(t: str) -> str:
    context = "the|of|" + "|".join(E.MONTHS)
    for n in range(len(E.ORDINALS), 0, -1):
        t = rf"regexp_replace({t}, '\b({context}) {E.ORDINALS[n - 1]}\b', '\1 {n}{E.suffix(n)}', 'g')"
    return t


@query(f"SELECT utt_id, {_sql_digits('lower(text)')} AS text FROM {_S}")
def word_numbers_to_digits(spark, sf):
    return says(spark, sf).select("utt_id", E.digits_for_words(low()).alias("text"))


@query(f"SELECT utt_id, {_sql_ordinals('lower(text)')} AS text FROM {_S}")
def word_ordinals_to_digits(spark, sf):
    return says(spark, sf).select("utt_id", E.digits_for_ordinals(low()).alias("text"))


# The same readings as SQL, over columns t (lowered, numbers as digits) and n (now).
_ISO = "'%Y-%m-%dT%H:%M+00:00'"
_TODAY, _WEEKDAY = "n::DATE", "(isodow(n) - 1)"
_SCALE = "CASE {0} WHEN 'minute' THEN 1 WHEN 'hour' THEN 60 WHEN 'day' THEN 1440 WHEN 'week' THEN 10080 END"
_IN_N, _IN_A, _IN_SOME = r"\b(?:in|for) ([0-9]{1,6}) ?(minute|hour|day|week)s?\b", r"\bin an? (minute|hour|day|week)\b", r"\bin a (few|couple)(?: of)? (minute|hour)s?\b"
_REL = rf"""CASE WHEN regexp_matches(t, '{_IN_N}') THEN regexp_extract(t, '{_IN_N}', 1)::BIGINT * {_SCALE.format(f"regexp_extract(t, '{_IN_N}', 2)")}
 WHEN regexp_matches(t, '{_IN_A}') THEN {_SCALE.format(f"regexp_extract(t, '{_IN_A}', 1)")}
 WHEN regexp_matches(t, '{_IN_SOME}') THEN CASE WHEN contains(t, 'few') THEN 3 ELSE 2 END * {_SCALE.format(f"regexp_extract(t, '{_IN_SOME}', 2)")}
 WHEN contains(t, 'in half an hour') THEN 30 END"""
_ANCHOR = f"CASE WHEN {_word_in('t', 'yesterday')} THEN NULL " + " ".join(f"WHEN {_word_in('t', w)} THEN ({_TODAY} + {n})::DATE" for w, n in E.ANCHORS.items()) + " END"
_WD = "CASE " + " ".join(f"WHEN {_word_in('t', w)} THEN ({_TODAY} + (1 + ({i} + 6 - {_WEEKDAY}) % 7)::INT)::DATE" for i, w in enumerate(E.WEEKDAYS)) + " END"
_WEEKEND = f"CASE WHEN {_word_in('t', 'weekend')} THEN ({_TODAY} + ((12 - {_WEEKDAY}) % 7)::INT)::DATE END"
_MONTHS = "|".join(E.MONTHS)
_MD, _DM, _THE = rf"\b({_MONTHS}) ([0-9]{{1,2}})(?:st|nd|rd|th)?\b", rf"\b([0-9]{{1,2}})(?:st|nd|rd|th)? (?:of )?({_MONTHS})\b", r"\bthe ([0-9]{1,2})(?:st|nd|rd|th)\b"


def _sql_absolute(t: str) -> str:
    month = f"list_position([{', '.join(map(O.quoted, E.MONTHS))}], CASE WHEN regexp_matches({t}, '{_MD}') THEN regexp_extract({t}, '{_MD}', 1) ELSE regexp_extract({t}, '{_DM}', 2) END)"
    day = f"CASE WHEN regexp_matches({t}, '{_MD}') THEN regexp_extract({t}, '{_MD}', 2) ELSE regexp_extract({t}, '{_DM}', 1) END"
    made = lambda y, m, d: f"try_cast(concat({y}, '-', {m}, '-', {d}) AS DATE)"
    this, later = made("year(n)", month, day), made("year(n) + 1", month, day)
    the = f"regexp_extract({t}, '{_THE}', 1)"
    here, after = made("year(n)", "month(n)", the), made(f"year({_TODAY} + INTERVAL 1 MONTH)", f"month({_TODAY} + INTERVAL 1 MONTH)", the)
    return f"CASE WHEN {month} > 0 THEN CASE WHEN {this} >= {_TODAY} THEN {this} ELSE {later} END WHEN {the} <> '' THEN CASE WHEN {here} >= {_TODAY} THEN {here} ELSE {after} END END"


def _x(p: str, i: int) -> str:
    return f"try_cast(regexp_extract(t, '{p}', {i}) AS INT)"


_PAST, _TO = r"\b([0-9]{1,2}) (?:minutes )?past ([0-9]{1,2})\b", r"\b([0-9]{1,2}) (?:minutes )?to ([0-9]{1,2})\b"
_HALF, _QP, _QT, _COLON, _AMPM, _AT = r"\bhalf past ([0-9]{1,2})\b", r"\bquarter past ([0-9]{1,2})\b", r"\bquarter to ([0-9]{1,2})\b", r"\b([0-9]{1,2})[:.h]([0-9]{2})\b", r"\b([0-9]{1,2}) ?(?:am|pm)\b", r"\bat ([0-9]{1,2})\b"
_FORMS = (
    (_HALF, _x(_HALF, 1), "30"), (_QP, _x(_QP, 1), "15"), (_QT, f"{_x(_QT, 1)} - 1", "45"), (_PAST, _x(_PAST, 2), _x(_PAST, 1)), (_TO, f"{_x(_TO, 2)} - 1", f"60 - {_x(_TO, 1)}"),
    (_COLON, _x(_COLON, 1), _x(_COLON, 2)), (_AMPM, _x(_AMPM, 1), "0"), (_AT, _x(_AT, 1), "0"),
)
_HOUR = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {h}" for p, h, _ in _FORMS) + " END"
_MINUTE = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {m}" for p, _, m in _FORMS) + " END"
_AM = r"nullif(regexp_extract(t, '[0-9] ?(am|pm)\b', 1), '')"
_PERIOD = "CASE " + " ".join(f"WHEN {_word_in('t', w if w != 'night' else 'night|tonight')} THEN '{w}'" for w in E.PERIODS) + " END"


def _sql_future(rows: str) -> str:
    """(*, chosen) for ``rows`` with hour, minute, half, base (a date) and n: the next such instant."""
    at = lambda h: f"(base + to_hours({h}) + to_minutes(minute))"
    return f"""SELECT *, CASE WHEN picked <= n THEN picked + INTERVAL 1 DAY ELSE picked END AS chosen FROM (SELECT *, CASE WHEN base::DATE = n::DATE AND {at('h')} <= n AND half IS NULL AND {at('o')} > n THEN {at('o')} ELSE {at('h')} END AS picked
 FROM (SELECT *, CASE WHEN h < 12 THEN h + 12 ELSE h - 12 END AS o FROM (SELECT *, CASE WHEN hour > 12 THEN hour WHEN half IN ('am', 'morning') THEN hour % 12 WHEN half IN ('pm', 'afternoon', 'evening', 'night') THEN hour % 12 + 12 WHEN hour BETWEEN 1 AND 6 THEN hour + 12 ELSE hour END AS h FROM ({rows}))))"""


def _sql_resolved(rows: str) -> str:
    """(*, at_time, day, timed) for ``rows`` with text and n."""
    default = "CASE period " + " ".join(f"WHEN '{w}' THEN {h}" for w, h in E.PERIODS.items()) + " END"
    parsed = f"SELECT *, coalesce({_ANCHOR}, {_sql_absolute('t')}, {_WEEKEND}, {_WD}) AS day, {_HOUR} AS clock_hour, {_MINUTE} AS clock_minute, {_AM} AS am, {_PERIOD} AS period, {_REL} AS rel FROM (SELECT *, {_sql_digits(_sql_ordinals('lower(text)'))} AS t FROM ({rows}))"
    full = f"SELECT *, coalesce(clock_hour, {default}) AS hour, coalesce(clock_minute, 0) AS minute, CASE WHEN clock_hour IS NULL THEN 'exact' ELSE coalesce(am, period) END AS half, coalesce(day, n::DATE) AS base FROM ({parsed})"
    own = [c for c in ("t", "clock_hour", "clock_minute", "am", "period", "rel", "hour", "minute", "half", "base", "h", "o", "picked", "chosen")]
    return f"SELECT * EXCLUDE ({', '.join(own)}), rel IS NOT NULL AS relative, (rel IS NOT NULL OR clock_hour IS NOT NULL OR period IS NOT NULL) AS timed, CASE WHEN {_word_in('t', 'yesterday')} THEN NULL WHEN rel IS NOT NULL THEN n + to_minutes(rel) WHEN hour IS NOT NULL THEN chosen ELSE day END AS at_time FROM ({_sql_future(full)})"


_LOW = f"(SELECT utt_id, n, lower(text) AS t FROM {_S})"


@query(f"SELECT utt_id, strftime(n + to_minutes({_REL}), {_ISO}) AS at_time FROM {_LOW}")
def dt_relative(spark, sf):
    return says(spark, sf).select("utt_id", E.utc_iso(E.relative(low(), F.col("now"))).alias("at_time"))


@query(f"SELECT utt_id, contains(t, 'yesterday') AS rejected FROM {_LOW}")
def dt_past_reject(spark, sf):
    return says(spark, sf).select("utt_id", E.word_in(low(), "yesterday").alias("rejected"))


@query(f"SELECT utt_id, {_ANCHOR} AS day FROM {_LOW}")
def dt_day_anchor(spark, sf):
    return says(spark, sf).select("utt_id", E.anchor(low(), F.col("now")).alias("day"))


@query(f"SELECT utt_id, {_WD} AS day FROM {_LOW}")
def dt_weekday(spark, sf):
    return says(spark, sf).select("utt_id", E.weekday(low(), F.col("now")).alias("day"))


@query(f"SELECT utt_id, {_WEEKEND} AS day FROM {_LOW}")
def dt_weekend(spark, sf):
    return says(spark, sf).select("utt_id", E.weekend(low(), F.col("now")).alias("day"))


@query(f"SELECT utt_id, {_sql_absolute('t')} AS day FROM (SELECT utt_id, n, {_sql_ordinals('lower(text)')} AS t FROM {_S})")
def dt_absolute(spark, sf):
    return says(spark, sf).select("utt_id", E.absolute(E.digits_for_ordinals(low()), F.col("now")).alias("day"))


_CLOCK = f"(SELECT utt_id, n, {_sql_digits('lower(text)')} AS t FROM {_S})"


@query(rf"SELECT utt_id, CASE WHEN regexp_matches(t, '\b(past|to) [0-9]') THEN printf('%d:%02d', {_HOUR}, {_MINUTE}) END AS clock FROM {_CLOCK}")
def dt_clock_idiom(spark, sf):
    t = E.digits_for_words(low())
    at = F.when(t.rlike(r"\b(past|to) [0-9]"), E.clock(t))
    return says(spark, sf).select("utt_id", F.when(at.isNotNull(), F.format_string("%d:%02d", at["hour"], at["minute"])).alias("clock"))


@query(f"SELECT utt_id, {_HOUR} AS hour, CASE WHEN {_HOUR} IS NOT NULL THEN {_AM} END AS half FROM {_CLOCK}")
def dt_clock_forms(spark, sf):
    at = E.clock(E.digits_for_words(low()))
    return says(spark, sf).select("utt_id", at["hour"].alias("hour"), at["half"].alias("half"))


_HALVES = "CASE event_id % 5 WHEN 0 THEN 'am' WHEN 1 THEN 'pm' WHEN 2 THEN 'evening' END"


@query(f"SELECT event_id AS utt_id, strftime(chosen, {_ISO}) AS at_time FROM ({_sql_future(f'SELECT event_id, ts AS n, (event_id % 24)::INT AS hour, (event_id % 60)::INT AS minute, {_HALVES} AS half, (ts::DATE + (event_id % 3)::INT)::DATE AS base FROM events')})")
def dt_pick_future(spark, sf):
    i = F.col("event_id")
    half = F.when(i % 5 == 0, "am").when(i % 5 == 1, "pm").when(i % 5 == 2, "evening")
    day = F.date_add("ts", (i % 3).cast("int"))
    return table(spark, sf, "events").select(i.alias("utt_id"), E.utc_iso(E.future(i % 24, i % 60, day, F.col("ts"), half)).alias("at_time"))


@query(f"SELECT utt_id, strftime(at_time, {_ISO}) AS at_time FROM ({_sql_resolved(_S)})")
def dt_period_combine(spark, sf):
    return E.resolved(says(spark, sf), "text", "now").select("utt_id", E.utc_iso(F.col("at_time")).alias("at_time"))


_PLAIN = f"SELECT utt_id, user_id, n AS now, text, at_time AS plain, timed, day IS NOT NULL OR relative AS own FROM ({_sql_resolved(_S)})"
_STATE = f"SELECT *, last(CASE WHEN plain IS NULL THEN NULL WHEN timed THEN {{'day': NULL::DATE}} ELSE {{'day': plain::DATE}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).day AS held FROM ({_PLAIN})"
_ANCHORED = f"SELECT utt_id, text, plain, held, timed AS has_time, CASE WHEN NOT own AND held IS NOT NULL THEN held::TIMESTAMP ELSE now END AS n FROM ({_STATE})"


@query(f"SELECT utt_id, CASE WHEN filled THEN strftime(at_time, {_ISO}) END AS at_time, filled, CASE WHEN plain IS NULL THEN held WHEN NOT has_time THEN plain::DATE END AS parked FROM (SELECT *, coalesce(plain IS NOT NULL AND has_time, FALSE) AS filled FROM ({_sql_resolved(_ANCHORED)}))")
def dt_park_partial(spark, sf):
    """The answers of a user as one dialogue: a day alone is parked until a time comes."""
    return E.parked(says(spark, sf), "text", "now", "user_id", "utt_id").select("utt_id", E.utc_iso(F.col("at_time")).alias("at_time"), "filled", "parked")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M+00:00') AS iso FROM events")
def dt_to_utc_iso(spark, sf):
    return table(spark, sf, "events").select("event_id", E.utc_iso(F.col("ts")).alias("iso"))


def _sql_times(t: str) -> str:
    t = f"replace({t}, ' ', '  ')"
    for p in E.STRIPPED:
        t = f"regexp_replace({t}, '(^|[^{E.LETTERS}])(?:{p})([^{E.LETTERS}]|$)', '\\1\\2', 'g')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


@query(f"SELECT doc_id, {_sql_times('lower(text)')} AS text FROM documents")
def strip_datetime(spark, sf):
    return docs(spark, sf).select("doc_id", E.without_times(low()).alias("text"))


_CARRIED = "lower(text)"
for _p in R.CARRIERS:
    _CARRIED = f"regexp_replace({_CARRIED}, {O.quoted(_p)}, '')"


@query(f"SELECT utt_id, regexp_replace({_sql_times(f'trim({_CARRIED})')}, '^({'|'.join(E.CONNECTORS)})( +|$)', '') AS topic FROM {_T}")
def derive_topic(spark, sf):
    return turns(spark, sf).select("utt_id", E.without_connector(E.without_times(R.without_carriers(F.col("text")))).alias("topic"))


SYNONYMS = [("Restaurant", "restaurant"), ("Restaurant", "place to eat"), ("Outdoor", "outdoor"), ("Outdoor", "outside in the park"), ("Car", "car"), ("Television", "television"), ("Television", "tv")]
ASKED = ("switch to restraunt", "i am outside in the park now", "the cab is here", "watching tv", "telvision mode", "restaurant", "nothing of the kind", "outdor please", "")
_A = f"(SELECT event_id AS utt_id, said[event_id % {len(ASKED)} + 1] AS t FROM events, (SELECT [{', '.join(map(O.quoted, ASKED))}] AS said))"
_E = f"a AS {_A}, y AS {values('canonical, synonym', SYNONYMS)}, exact AS (SELECT utt_id, canonical, synonym, CASE WHEN lower(canonical) = synonym THEN 1.0 ELSE 0.95 END::DOUBLE AS conf FROM a JOIN y ON regexp_matches(t, concat('(^|[^a-z0-9])', synonym, '([^a-z0-9]|$)')) QUALIFY row_number() OVER (PARTITION BY utt_id ORDER BY length(synonym) DESC, synonym) = 1)"


def _exact(spark, sf):
    a = table(spark, sf, "events").select(F.col("event_id").alias("utt_id"), _said(ASKED).alias("t"))
    y = inline(spark, "canonical string, synonym string", SYNONYMS)
    hits = a.crossJoin(F.broadcast(y)).filter(F.contains(F.concat(F.lit(" "), F.regexp_replace("t", "[^a-z0-9]", " "), F.lit(" ")), F.concat(F.lit(" "), "synonym", F.lit(" "))))
    w = Window.partitionBy("utt_id").orderBy(F.desc(F.length("synonym")), "synonym")
    conf = F.when(F.lower("canonical") == F.col("synonym"), 1.0).otherwise(0.95)
    return a, y, hits.withColumn("n", F.row_number().over(w)).filter("n = 1").select("utt_id", "canonical", "synonym", conf.alias("conf"))


@query(f"WITH {_E} SELECT * FROM exact")
def enum_lookup(spark, sf):
    """The longest synonym that occurs as whole words; the synonym table is a small broadcast side."""
    return _exact(spark, sf)[2]


@query(f"""WITH {_E}, k AS (SELECT utt_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS token FROM a WHERE utt_id NOT IN (SELECT utt_id FROM exact)), d AS (SELECT utt_id, canonical, synonym, token, levenshtein(token, synonym) AS d FROM k JOIN y ON NOT contains(synonym, ' ') AND length(synonym) >= 5 AND token NOT IN ('the', 'three')),
b AS (SELECT * FROM d WHERE d <= greatest(1, round(length(synonym) * 0.3::DOUBLE)) QUALIFY row_number() OVER (PARTITION BY utt_id ORDER BY d, synonym, token) = 1)
SELECT utt_id, canonical, token AS span, round(least(0.9::DOUBLE, greatest(0.6::DOUBLE, round(1 - d / length(synonym)::DOUBLE, 2))), 6) AS conf FROM b""")
def enum_fuzzy(spark, sf):
    a, y, exact = _exact(spark, sf)
    tokens = a.join(exact, "utt_id", "left_anti").select("utt_id", F.explode(F.regexp_extract_all("t", F.lit("[a-z0-9]+"), F.lit(0))).alias("token")).filter(~F.col("token").isin("the", "three"))
    limit = F.greatest(F.lit(1), F.bround(F.length("synonym") * 0.3))
    single = y.filter(~F.contains("synonym", F.lit(" ")) & (F.length("synonym") >= 5)).withColumn("limit", limit)
    near = tokens.crossJoin(F.broadcast(single)).filter(F.abs(F.length("token") - F.length("synonym")) <= F.col("limit"))
    near = near.withColumn("d", F.levenshtein("token", "synonym")).filter("d <= limit")
    w = Window.partitionBy("utt_id").orderBy("d", "synonym", "token")
    conf = F.least(F.lit(0.9), F.greatest(F.lit(0.6), F.round(1 - F.col("d") / F.length("synonym"), 2)))
    return near.withColumn("n", F.row_number().over(w)).filter("n = 1").select("utt_id", "canonical", F.col("token").alias("span"), F.round(conf, 6).alias("conf"))


@query(f"WITH {_E} SELECT utt_id, conf >= 0.9 AS answers FROM a JOIN exact USING (utt_id)")
def answers_awaited_slot(spark, sf):
    return _exact(spark, sf)[2].select("utt_id", (F.col("conf") >= 0.9).alias("answers"))


_KIND = "CASE utt_id % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'day' ELSE 'yesno' END"
_SAID = f"CASE WHEN {sql_word('lower(trim(text))', ('no',))} THEN 'false' WHEN {sql_word('lower(trim(text))', ('yes',))} THEN 'true' END"


@query(f"SELECT utt_id, {_KIND} AS entity, CASE {_KIND} WHEN 'number' THEN ({_NUM})::VARCHAR WHEN 'day' THEN ({_ANCHOR})::VARCHAR ELSE {_SAID} END AS value FROM (SELECT *, lower(text) AS t FROM {_S})")
def extract_dispatch(spark, sf):
    i = F.col("utt_id")
    rows = says(spark, sf).withColumn("entity", F.when(i % 3 == 0, "number").when(i % 3 == 1, "day").otherwise("yesno"))
    value = F.when(F.col("entity") == "number", E.number(low()).cast("string")).when(F.col("entity") == "day", E.anchor(low(), F.col("now")).cast("string")).when(F.col("entity") == "yesno", R.yes_no(F.col("text"), ("yes",), ("no",)).cast("string"))
    return rows.select("utt_id", "entity", value.alias("value"))
