"""Dialogue state: a keyed state machine, the same for a batch replay and for a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns without an answer after which a confirmation or slot is given up; seconds that a context lives, and idle
#: seconds after which a session starts anew (both strict).
ATTEMPTS, CONTEXT_TTL, IDLE = 3, 90, 600
RESULT = "type string, intent string, state string"


def sessions(df: DataFrame, user: str, ts: str, idle: int = IDLE, tie: str | None = None) -> DataFrame:
    """``df`` with a session number for each user: a gap of more than ``idle`` seconds starts a new one."""
    w = Window.partitionBy(user).orderBy(ts, *([tie] if tie else []))
    gap = F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w)
    new = F.when(gap > idle * 1_000_000, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("session_no", F.sum("__new").over(w)).drop("__new")


def expired(since: Column, now: Column, ttl: int = CONTEXT_TTL) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(since) > ttl


def fresh() -> dict:
    return {"pending": None, "slot": None, "attempts": 0, "last": None, "lifespan": 0}


def step(state: dict, intent: str | None, conf: float, answer: str | None) -> tuple[dict, str, str | None]:
    """One turn: (state, result type, intent). ``answer`` is yes, no, value, cancel or null.

    A pending confirmation or slot comes first; a confident other intent interrupts it; after three turns
    without an answer it is dropped. Intents named ask_* need a confirmation, slot_* a value.
    """
    s = dict(state)
    waiting = s["pending"] or s["slot"]
    if waiting:
        if answer == "cancel" or (s["pending"] and answer == "no"):
            return s | {"pending": None, "slot": None, "attempts": 0}, "CANCEL", waiting
        if (s["pending"] and answer == "yes") or (s["slot"] and answer == "value"):
            return s | {"pending": None, "slot": None, "attempts": 0, "last": waiting, "lifespan": 2}, "FULFILL", waiting
        if not (intent and conf >= 0.7 and intent != waiting):
            tries = s["attempts"] + 1
            if tries >= ATTEMPTS:
                return s | {"pending": None, "slot": None, "attempts": 0}, "FALLBACK", waiting
            return s | {"attempts": tries}, "PROMPT", waiting
        s |= {"pending": None, "slot": None, "attempts": 0}
    s["lifespan"] = max(0, s["lifespan"] - 1)
    if intent == "repeat" and s["last"] and s["lifespan"] > 0:
        return s, "FULFILL", s["last"]
    if not intent or conf < 0.5 or intent == "repeat":
        return s, "FALLBACK", None
    if intent.startswith("ask_"):
        return s | {"pending": intent}, "CONFIRM", intent
    if intent.startswith("slot_"):
        return s | {"slot": intent}, "PROMPT", intent
    return s | {"last": intent, "lifespan": 2}, "FULFILL", intent


def _run(rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
    out = []
    for r in rows.sort_values("turn").itertuples():
        intent = None if pd.isna(r.intent) else r.intent
        answer = None if pd.isna(r.answer) else r.answer
        state, kind, said = step(state, intent, 0.0 if pd.isna(r.conf) else r.conf, answer)
        out.append((r.conv_id, r.turn, kind, said, json.dumps(state, sort_keys=True)))
    return pd.DataFrame(out, columns=["conv_id", "turn", "type", "intent", "state"]), state


#: What a turn did: (type, whose intent) by the act that ``_acted`` names.
_TYPES = {"cancel": "CANCEL", "done": "FULFILL", "drop": "FALLBACK", "wait": "PROMPT", "again": "FULFILL", "none": "FALLBACK", "ask": "CONFIRM", "slot": "PROMPT", "fire": "FULFILL"}
_STATE = "pending string, slot string, attempts int, last string, lifespan int"


def _acted(s: Column, x: Column) -> Column:
    """The act of a turn ``x`` (intent, conf, answer) in state ``s``, as in ``step``."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    waiting, intent, conf, answer = F.coalesce(s["pending"], s["slot"]), x["intent"], F.coalesce(x["conf"], F.lit(0.0)), x["answer"]
    asked, open_slot = s["pending"].isNotNull(), s["pending"].isNull() & s["slot"].isNotNull()
    return (
        F.when(yes(waiting.isNotNull() & ((answer == "cancel") | (asked & (answer == "no")))), "cancel")
        .when(yes((asked & (answer == "yes")) | (open_slot & (answer == "value"))), "done")
        .when(waiting.isNotNull() & ~yes((conf >= 0.7) & (intent != waiting)), F.when(s["attempts"] + 1 >= ATTEMPTS, "drop").otherwise("wait"))
        .when(yes((intent == "repeat") & s["last"].isNotNull() & (s["lifespan"] > 1)), "again")
        .when(yes(intent.isNull() | (conf < 0.5) | (intent == "repeat")), "none")
        .when(intent.startswith("ask_"), "ask").when(intent.startswith("slot_"), "slot").otherwise("fire")
    )


def _next(s: Column, x: Column) -> Column:
    """The state after a turn, with type and intent of its result."""

    def after(act: Column) -> Column:
        held, waiting, intent = act.isin("cancel", "done", "drop", "wait"), F.coalesce(s["pending"], s["slot"]), x["intent"]
        kind = F.lit(None).cast("string")
        for name, says in _TYPES.items():
            kind = F.when(act == name, says).otherwise(kind)
        return F.struct(
            F.when(act == "wait", s["pending"]).when(act == "ask", intent).alias("pending"), F.when(act == "wait", s["slot"]).when(act == "slot", intent).alias("slot"),
            F.when(act == "wait", s["attempts"] + 1).otherwise(0).alias("attempts"), F.when(act == "done", waiting).when(act == "fire", intent).otherwise(s["last"]).alias("last"),
            F.when(act.isin("done", "fire"), 2).when(held, s["lifespan"]).otherwise(F.greatest(F.lit(0), s["lifespan"] - 1)).alias("lifespan"),
            kind.alias("type"), F.when(held, waiting).when(act == "again", s["last"]).when(act != "none", intent).alias("intent"), x["turn"].alias("turn"),
        )

    return F.get(F.transform(F.array(_acted(s, x)), after), F.lit(0))


def replay(turns: DataFrame) -> DataFrame:
    """All turns (conv_id, turn, intent, conf, answer) through the state machine: conv_id, turn, type, intent and the state after it.

    A conversation is folded in one row, inside the JVM; its turns should fit a task.
    """
    row = f"struct<{', '.join(c.replace(' ', ': ') for c in (_STATE + ', type string, intent string, turn bigint').split(', '))}>"
    start = F.array(F.struct(*(F.lit(0 if c.endswith("int") else None).cast(c.split()[1]).alias(c.split()[0]) for c in (_STATE + ", type string, intent string, turn bigint").split(", "))).cast(row))
    given = F.array_sort(F.collect_list(F.struct("turn", "intent", F.col("conf").cast("double").alias("conf"), "answer")))
    told = F.aggregate("given", start, lambda out, x: F.concat(out, F.array(_next(F.element_at(out, -1), x).cast(row))))
    rows = turns.groupBy("conv_id").agg(given.alias("given")).select("conv_id", F.inline(F.slice(told, 2, 1 << 30)))
    return rows.select("conv_id", "turn", "type", "intent", "pending", "slot", "attempts", "last", "lifespan")


#: Rows of an as-of join that share a bucket of the order column: a key is searched in buckets of that many values.
SPAN = 1 << 20


def newest(asked: DataFrame, facts: DataFrame, key: str, at: str, since: str, value: str, span: int = SPAN) -> DataFrame:
    """``asked`` with the ``value`` of the newest of ``facts`` for its ``key`` up to ``at`` (inclusive), else null.

    Both sides run through one window for each key and bucket of ``span`` of the whole-numbered order; what a bucket
    starts with is the last value of the buckets before it, one row for each. A null value is no fact.
    """
    bucket = lambda c: F.floor(F.col(c) / span)
    facts = facts.filter(F.col(value).isNotNull()).withColumn("__b", bucket(since))
    ends = facts.groupBy(key, "__b").agg(F.max(F.struct(since, value))[value].alias("__end"))
    both = asked.withColumn("__b", bucket(at)).withColumn("__at", F.col(at)).withColumn("__kind", F.lit(1)).unionByName(facts.select(key, F.col(since).alias("__at"), "__b", F.lit(0).alias("__kind"), F.col(value).alias("__v")), allowMissingColumns=True)
    w = Window.partitionBy(key, "__b").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("__now", F.last("__v", ignorenulls=True).over(w)).filter("__kind = 1")
    cells = within.select(key, "__b").distinct().withColumn("__open", F.lit(True)).unionByName(ends, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("__b").rangeBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("__start", F.last("__end", ignorenulls=True).over(before)).filter("__open").select(key, "__b", "__start")
    return within.join(starts, [key, "__b"], "left").select(*asked.columns, F.coalesce("__now", "__start").alias(value))


def capabilities(intents: DataFrame, owners: DataFrame, id: str) -> DataFrame:
    """(id, capability) of intents (id, intent): that of the longest dotted beginning that owners (prefix, capability) has, else null."""
    parts = F.split("intent", "[.]")
    starts = F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))
    hits = intents.select(id, "intent", starts.alias("prefix")).filter(F.length("prefix") < F.length("intent")).join(owners, "prefix")
    best = hits.groupBy(id).agg(F.max(F.struct(F.length("prefix").alias("n"), "capability"))["capability"].alias("capability"))
    return intents.select(id).join(best, id, "left")


def stream(turns: DataFrame) -> DataFrame:
    """The same over a stream; the state travels as JSON. Turns of a conversation must arrive in order of batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        found, now = _run(rows, json.loads(state.get[0]) if state.exists else fresh())
        state.update((json.dumps(now),))
        yield found

    return turns.groupBy("conv_id").applyInPandasWithState(update, f"conv_id long, turn long, {RESULT}", "state string", "append", "NoTimeout")


def counters(events: DataFrame, *by: str, day: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts for each day and key: batch or stream (with a watermark, update mode)."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", day), *by).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *by, "n")
