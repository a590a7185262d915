"""Dialogue, session and counter queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import entities as E
from brindle.functions import rules as R
from brindle.operators import dialogue as D
from brindle.plans.catalog import query
from brindle.plans.entities import _NUM as NUMBER
from brindle.plans.rules import _INTENT as INTENT
from brindle.plans.rules import _T, CANCEL, CANCELS, NO, RULES, YES, turns
from brindle.plans.rules import _YESNO as POLARITY
from brindle.sources.tables import table

EIGHT_HOURS = 8 * 3600


def conversations(spark, sf):
    return table(spark, sf, "conversations")


@query("WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 8 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM g) SELECT user_id, session_no::BIGINT AS session_no, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def session_idle_reset(spark, sf):
    s = D.sessions(table(spark, sf, "events"), "user_id", "ts", EIGHT_HOURS, "event_id")
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(date_diff('second', date_trunc('second', lag(ts) OVER w), date_trunc('second', ts)) > 90, TRUE) AS expired FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def context_ttl(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.coalesce(D.expired(F.lag("ts").over(w), F.col("ts")), F.lit(True)).alias("expired"))


@query("SELECT conv_id, turn, greatest(0, 3 - row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS lifespan FROM conversations")
def context_lifespan(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return conversations(spark, sf).select("conv_id", "turn", F.greatest(F.lit(0), 3 - F.row_number().over(w)).cast("int").alias("lifespan"))


@query("SELECT conv_id, turn, last(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS refers_to FROM conversations")
def back_reference(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return conversations(spark, sf).select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("refers_to"))


#: The state machine's name for the intents of the rules, and how sure each kind of rule is.
_NAMES = {"mute": "ask_mute", "remind": "slot_remind"}
_SURE = {"exact": 0.95, "contains": 0.8, "regex": 0.75, "regex_guarded": 0.6}
_REPEAT = "the other one"


def scripted(spark, sf):
    """The turns that the rules read: (conv_id, turn, intent, conf, answer) from each text; eight conversations make one."""
    said = turns(spark, sf).withColumn("low", F.lower("text")).withColumn("hit", R.first_rule(F.col("low"), RULES))
    intent, sure = F.col("hit.intent"), F.lit(0.2)
    for k, v in _NAMES.items():
        intent = F.when(F.col("hit.intent") == k, v).otherwise(intent)
    for k, v in _SURE.items():
        sure = F.when(F.col("hit.tier") == k, v).otherwise(sure)
    polarity = R.yes_no(F.col("text"), YES, NO)
    answer = F.when(R.cancels(F.col("text"), CANCEL, YES, NO), "cancel").when(polarity, "yes").when(~polarity, "no").when(E.number(F.col("low")).isNotNull(), "value")
    conv, again = F.floor(F.col("utt_id") / 1000), F.contains("low", F.lit(_REPEAT))
    return said.select(F.floor(conv / 8).alias("conv_id"), (conv % 8 * 1000 + F.col("utt_id") % 1000).alias("turn"), F.when(again, "repeat").otherwise(intent).alias("intent"), F.when(again, 0.9).otherwise(sure).alias("conf"), answer.alias("answer"))


def _cases(column: str, table: dict) -> str:
    return " ".join(f"WHEN {column} = '{k}' THEN {v!r}" for k, v in table.items())


_SCRIPT = f"""(SELECT utt_id // 1000 // 8 AS conv_id, utt_id // 1000 % 8 * 1000 + utt_id % 1000 AS turn, CASE WHEN contains(lower(text), '{_REPEAT}') THEN 'repeat' {_cases('hit', _NAMES)} ELSE hit END AS intent,
 CASE WHEN contains(lower(text), '{_REPEAT}') THEN 0.9 WHEN hit = 'mute' THEN 0.95 WHEN hit = 'translate' THEN 0.8 WHEN hit = 'remind' THEN 0.75 WHEN hit = 'volume_up' THEN 0.6 ELSE 0.2 END::DOUBLE AS conf,
 CASE WHEN {CANCELS} THEN 'cancel' WHEN {POLARITY} THEN 'yes' WHEN NOT {POLARITY} THEN 'no' WHEN {NUMBER} IS NOT NULL THEN 'value' END AS answer FROM (SELECT utt_id, text, {INTENT} AS hit FROM {_T}))"""


def _replayed(columns: str, intent: str = "intent", tail: str = "") -> str:
    """The state machine as a recursion over the turns of each conversation."""
    act = """CASE WHEN w IS NOT NULL AND (answer = 'cancel' OR (pending IS NOT NULL AND answer = 'no')) THEN 'cancel' WHEN (pending IS NOT NULL AND answer = 'yes') OR (pending IS NULL AND slot IS NOT NULL AND answer = 'value') THEN 'done'
 WHEN w IS NOT NULL AND NOT coalesce(said IS NOT NULL AND conf >= 0.7 AND said <> w, FALSE) THEN CASE WHEN attempts + 1 >= 3 THEN 'drop' ELSE 'wait' END WHEN said = 'repeat' AND last IS NOT NULL AND lifespan > 1 THEN 'again'
 WHEN said IS NULL OR conf < 0.5 OR said = 'repeat' THEN 'none' WHEN starts_with(said, 'ask_') THEN 'ask' WHEN starts_with(said, 'slot_') THEN 'slot' ELSE 'fire' END"""
    return f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {intent} AS said, conf, answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {_SCRIPT}),
m AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, NULL::BIGINT AS turn, NULL::VARCHAR AS type, NULL::VARCHAR AS intent, NULL::VARCHAR AS pending, NULL::VARCHAR AS slot, 0 AS attempts, NULL::VARCHAR AS last, 0 AS lifespan FROM t
 UNION ALL SELECT conv_id, n, turn, CASE WHEN act = 'cancel' THEN 'CANCEL' WHEN act IN ('done', 'again', 'fire') THEN 'FULFILL' WHEN act IN ('drop', 'none') THEN 'FALLBACK' WHEN act = 'ask' THEN 'CONFIRM' ELSE 'PROMPT' END,
 CASE WHEN act IN ('cancel', 'done', 'drop', 'wait') THEN w WHEN act = 'again' THEN last WHEN act <> 'none' THEN said END, CASE WHEN act = 'wait' THEN pending WHEN act = 'ask' THEN said END, CASE WHEN act = 'wait' THEN slot WHEN act = 'slot' THEN said END,
 CASE WHEN act = 'wait' THEN attempts + 1 ELSE 0 END, CASE WHEN act = 'done' THEN w WHEN act = 'fire' THEN said ELSE last END, CASE WHEN act IN ('done', 'fire') THEN 2 WHEN act IN ('cancel', 'drop', 'wait') THEN lifespan ELSE greatest(0, lifespan - 1) END
 FROM (SELECT *, {act} AS act FROM (SELECT m.conv_id, t.n, t.turn, t.said, t.conf, t.answer, m.pending, m.slot, m.attempts, m.last, m.lifespan, coalesce(m.pending, m.slot) AS w FROM m JOIN t ON t.conv_id = m.conv_id AND t.n = m.n + 1)))
SELECT {columns} FROM m WHERE n > 0 {tail}"""


@query(_replayed("conv_id, turn, type, intent, pending, slot, attempts, last, lifespan"))
def turn_router(spark, sf):
    return D.replay(scripted(spark, sf))


@query(_replayed("conv_id, turn, type", "'ask_mute'"))
def confirm_fsm(spark, sf):
    return D.replay(scripted(spark, sf).withColumn("intent", F.lit("ask_mute"))).select("conv_id", "turn", "type")


@query(_replayed("conv_id, turn, type", "'slot_remind'"))
def slot_fsm(spark, sf):
    return D.replay(scripted(spark, sf).withColumn("intent", F.lit("slot_remind"))).select("conv_id", "turn", "type")


@query(_replayed("type, count(*)::BIGINT AS n", tail="GROUP BY type"))
def conformance_replay(spark, sf):
    return D.replay(scripted(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, json_object('conv_id', conv_id, 'role', role, 'turn', turn)::VARCHAR AS blob, role FROM conversations")
def blob_roundtrip(spark, sf):
    rows = conversations(spark, sf).select("conv_id", "turn", F.to_json(F.struct("conv_id", "role", "turn")).alias("blob"))
    return rows.select("conv_id", "turn", "blob", F.from_json("blob", "conv_id long, role string, turn long")["role"].alias("role"))


_SNAPS = "(SELECT event_id AS snapshot_id, event_type AS capability, value > 10 AS available FROM events WHERE event_id % 3 = 0)"


def snapshots(spark, sf):
    """Every third event says whether its type is available."""
    return table(spark, sf, "events").filter("event_id % 3 = 0").select(F.col("event_id").alias("snapshot_id"), F.col("event_type").alias("capability"), (F.col("value") > 10).alias("available"))


@query(f"SELECT capability, available, snapshot_id FROM {_SNAPS} QUALIFY row_number() OVER (PARTITION BY capability ORDER BY snapshot_id DESC) = 1")
def availability_snapshot(spark, sf):
    return snapshots(spark, sf).groupBy("capability").agg(F.max(F.struct("snapshot_id", "available")).alias("x")).select("capability", "x.available", "x.snapshot_id")


@query(f"SELECT utt_id, coalesce(NOT available, FALSE) AS blocked FROM (SELECT event_id AS utt_id, event_type AS capability FROM events WHERE event_id % 3 <> 0) a ASOF LEFT JOIN {_SNAPS} s ON a.capability = s.capability AND a.utt_id >= s.snapshot_id")
def availability_block(spark, sf):
    """The newest snapshot up to the turn: an as-of join by a running last value over both, ordered by id."""
    asked = table(spark, sf, "events").filter("event_id % 3 <> 0").select(F.col("event_id").alias("utt_id"), F.col("event_type").alias("capability"))
    now = D.newest(asked, snapshots(spark, sf), "capability", "utt_id", "snapshot_id", "available")
    return now.select("utt_id", F.coalesce(~F.col("available"), F.lit(False)).alias("blocked"))


_INTENTS = "(SELECT p_partkey AS id, p_brand || '.' || p_type || '.' || p_partkey AS intent FROM part)"
_CAPS = "(SELECT DISTINCT p_brand AS prefix, 'brand' AS capability FROM part WHERE p_brand NOT LIKE '%3' UNION ALL SELECT DISTINCT p_brand || '.' || p_type, 'type' FROM part WHERE p_size > 45)"


@query(f"SELECT id, capability FROM {_INTENTS} LEFT JOIN {_CAPS} ON starts_with(intent, prefix || '.') QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(prefix) DESC NULLS LAST) = 1")
def capability_of(spark, sf):
    p = table(spark, sf, "part")
    i = p.select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_brand", "p_type", "p_partkey").alias("intent"))
    brands = p.filter("p_brand not like '%3'").select(F.col("p_brand").alias("prefix"), F.lit("brand").alias("capability")).distinct()
    types = p.filter("p_size > 45").select(F.concat_ws(".", "p_brand", "p_type"), F.lit("type")).distinct()
    return D.capabilities(i, brands.union(types), "id")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def daily_counter_stream(spark, sf):
    return D.counters(table(spark, sf, "events"), "event_type")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 10 AS bucket, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def sink_counters_upsert(spark, sf):
    return D.counters(table(spark, sf, "events").withColumn("bucket", F.col("user_id") % 10), "bucket")
