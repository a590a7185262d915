"""Entities and date-times as Column expressions over lowered English text and an explicit ``now`` column.

All words are parameters or the fixed tables below. Results are instants in the session zone; nothing reads the
clock of the machine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.rows import once

# Number words, in the order in which they are looked for.
NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
}
CLOCK_NUMBERS = {w: n for w, n in NUMBERS.items() if 0 < n < 60} | {"sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
# Ordinals up to the thirty-first, weekdays from Monday, months, units in minutes, periods and their hours.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
UNITS = {"minute": 1, "hour": 60, "day": 1440, "week": 10080}
PERIODS = {"morning": 8, "afternoon": 15, "evening": 18, "night": 20}
ANCHORS = {"day after tomorrow": 2, "tomorrow": 1, "tonight": 0, "today": 0, "next week": 7}


def word_in(t: Column, words: str) -> Column:
    return t.rlike(f"(^|[^a-z0-9])({words})([^a-z0-9]|$)")


def number(t: Column) -> Column:
    """The first run of digits that is a word, else the first number word of the table that occurs; a long.

    A run beyond the range of a long is no number: the result is null.
    """
    digits = F.regexp_extract(t, r"(^|[^a-z0-9_])([0-9]+)([^a-z0-9_]|$)", 2)
    out = F.lit(None).cast("long")
    for w, n in reversed(NUMBERS.items()):
        out = F.when(word_in(t, w), F.lit(n).cast("long")).otherwise(out)
    return F.when(digits != "", digits.try_cast("long")).otherwise(out)


def digits_for_words(t: Column) -> Column:
    for w in sorted(CLOCK_NUMBERS, key=len, reverse=True):
        t = F.regexp_replace(t, rf"\b{w}\b", str(CLOCK_NUMBERS[w]))
    return t


def suffix(n: int) -> str:
    return "th" if 11 <= n % 100 <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


def digits_for_ordinals(t: Column) -> Column:
    """Only after "the", "of" or a month, so that "wait a second" stays."""
    context = "the|of|" + "|".join(MONTHS)
    for n in range(len(ORDINALS), 0, -1):
        t = F.regexp_replace(t, rf"\b({context}) {ORDINALS[n - 1]}\b", f"$1 {n}{suffix(n)}")
    return t


def minutes_after(now: Column, minutes: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(now) + minutes * 60)


def relative(t: Column, now: Column) -> Column:
    """in/for N units, in a unit, in a few or a couple of minutes or hours, in half an hour; else null. N has six digits at most."""
    unit = lambda i, p: F.regexp_extract(t, p, i)
    scale = lambda u: sum((F.when(u == k, F.lit(v)).otherwise(F.lit(0)) for k, v in UNITS.items()), F.lit(0))
    n = r"\b(?:in|for) ([0-9]{1,6}) ?(minute|hour|day|week)s?\b"
    one, some = r"\bin an? (minute|hour|day|week)\b", r"\bin a (few|couple)(?: of)? (minute|hour)s?\b"
    count = F.when(unit(1, some) == "few", 3).otherwise(2)
    return (
        F.when(t.rlike(n), minutes_after(now, unit(1, n).try_cast("long") * scale(unit(2, n))))
        .when(t.rlike(one), minutes_after(now, scale(unit(1, one))))
        .when(t.rlike(some), minutes_after(now, count * scale(unit(2, some))))
        .when(t.rlike(r"\bin half an hour\b"), minutes_after(now, F.lit(30)))
    )


def anchor(t: Column, now: Column) -> Column:
    """The day that an anchor word names, by priority; null without one or with "yesterday"."""
    out = F.lit(None).cast("date")
    for w, days in reversed(ANCHORS.items()):
        out = F.when(word_in(t, w), F.date_add(now, days)).otherwise(out)
    return F.when(word_in(t, "yesterday"), F.lit(None).cast("date")).otherwise(out)


def weekday(t: Column, now: Column) -> Column:
    """The next such weekday, strictly after today."""
    out, today = F.lit(None).cast("date"), F.weekday(now)
    for i, w in reversed(list(enumerate(WEEKDAYS))):
        ahead = (F.lit(i + 7) - today) % 7
        out = F.when(word_in(t, w), F.date_add(now, F.when(ahead == 0, 7).otherwise(ahead))).otherwise(out)
    return out


def weekend(t: Column, now: Column) -> Column:
    return F.when(word_in(t, "weekend"), F.date_add(now, (F.lit(12) - F.weekday(now)) % 7))


def absolute(t: Column, now: Column) -> Column:
    """Month and day (this year or the next), or a bare ordinal (this month or the next); impossible days are null."""
    months = "|".join(MONTHS)
    first, second = rf"\b({months}) ([0-9]{{1,2}})(?:st|nd|rd|th)?\b", rf"\b([0-9]{{1,2}})(?:st|nd|rd|th)? (?:of )?({months})\b"
    name = F.when(t.rlike(first), F.regexp_extract(t, first, 1)).otherwise(F.regexp_extract(t, second, 2))
    day = F.when(t.rlike(first), F.regexp_extract(t, first, 2)).otherwise(F.regexp_extract(t, second, 1))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    make = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0.0)).cast("date")
    today, year = now.cast("date"), F.year(now)
    this = make(year, month, F.expr("0") + day.try_cast("int"))
    full = F.when(this >= today, this).otherwise(make(year + 1, month, F.expr("0") + day.try_cast("int")))
    bare = r"\bthe ([0-9]{1,2})(?:st|nd|rd|th)\b"
    d = F.regexp_extract(t, bare, 1).try_cast("int")
    here = make(year, F.month(now), d)
    after = F.add_months(F.trunc(now, "month"), 1)
    return F.when(month > 0, full).when(t.rlike(bare), F.when(here >= today, here).otherwise(make(F.year(after), F.month(after), d)))


def clock(t: Column) -> Column:
    """struct(hour, minute, half): half is am, pm or null. The first form that matches counts."""
    get = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    half = F.nullif(F.regexp_extract(t, r"[0-9] ?(am|pm)\b", 1), F.lit(""))
    out = lambda h, m: F.struct(h.cast("int").alias("hour"), m.cast("int").alias("minute"), half.alias("half"))
    zero = F.lit(0)
    past, to = r"\b([0-9]{1,2}) (?:minutes )?past ([0-9]{1,2})\b", r"\b([0-9]{1,2}) (?:minutes )?to ([0-9]{1,2})\b"
    half_past, quarter_past, quarter_to = r"\bhalf past ([0-9]{1,2})\b", r"\bquarter past ([0-9]{1,2})\b", r"\bquarter to ([0-9]{1,2})\b"
    colon, ampm, at = r"\b([0-9]{1,2})[:.h]([0-9]{2})\b", r"\b([0-9]{1,2}) ?(?:am|pm)\b", r"\bat ([0-9]{1,2})\b"
    return (
        F.when(t.rlike(half_past), out(get(half_past, 1), F.lit(30)))
        .when(t.rlike(quarter_past), out(get(quarter_past, 1), F.lit(15)))
        .when(t.rlike(quarter_to), out(get(quarter_to, 1) - 1, F.lit(45)))
        .when(t.rlike(past), out(get(past, 2), get(past, 1)))
        .when(t.rlike(to), out(get(to, 2) - 1, 60 - get(to, 1)))
        .when(t.rlike(colon), out(get(colon, 1), get(colon, 2)))
        .when(t.rlike(ampm), out(get(ampm, 1), zero))
        .when(t.rlike(at), out(get(at, 1), zero))
    )


def period(t: Column) -> Column:
    out = F.lit(None).cast("string")
    for w in reversed(list(PERIODS)):
        out = F.when(word_in(t, w if w != "night" else "night|tonight"), w).otherwise(out)
    return out


def future(hour: Column, minute: Column, day: Column, now: Column, half: Column) -> Column:
    """The next instant with that clock time on ``day``: by am/pm or period, else 1 to 6 are pm and the half that is still to come."""
    pm, am = F.coalesce(half.isin("pm", "afternoon", "evening", "night"), F.lit(False)), F.coalesce(half.isin("am", "morning"), F.lit(False))
    h = F.when(hour > 12, hour).when(am, hour % 12).when(pm, hour % 12 + 12).when(hour.between(1, 6), hour + 12).otherwise(hour)
    instant = lambda hh: F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + hh * 3600 + minute * 60)
    today = day == now.cast("date")
    other = F.when(h < 12, h + 12).otherwise(h - 12)
    swap = today & (instant(h) <= now) & half.isNull() & (instant(other) > now)
    chosen = F.when(swap, instant(other)).otherwise(instant(h))
    return F.when(chosen <= now, minutes_after(chosen, F.lit(1440))).otherwise(chosen)


_STEPS = ("__t", "__day", "__at", "__period", "__relative", "__hour", "__minute", "__half", "__base")


def _parsed(df: DataFrame, text: str, now: str) -> DataFrame:
    n = F.col(now)
    df = once(df, __t=digits_for_words(digits_for_ordinals(F.lower(text))))
    t = F.col("__t")
    return once(df, __day=F.coalesce(anchor(t, n), absolute(t, n), weekend(t, n), weekday(t, n)), __at=clock(t), __period=period(t), __relative=relative(t, n))


def resolved(df: DataFrame, text: str, now: str, name: str = "at_time") -> DataFrame:
    """``df`` with the instant that a text names, null if none: relative forms first, then day and clock together.

    Works in steps, each computed once a row: one nested expression would be copied beyond all bounds.
    """
    n = F.col(now)
    df = _parsed(df, text, now)
    t = F.col("__t")
    default = F.element_at(F.create_map(*(F.lit(x) for pair in PERIODS.items() for x in pair)), F.col("__period"))
    timed = F.col("__at").isNotNull()
    df = once(df, __hour=F.when(timed, F.col("__at.hour")).otherwise(default), __minute=F.when(timed, F.col("__at.minute")).otherwise(0), __half=F.when(timed, F.coalesce("__at.half", "__period")).otherwise(F.lit("exact")), __base=F.coalesce("__day", F.to_date(n)))
    full = future(F.col("__hour"), F.col("__minute"), F.col("__base"), n, F.col("__half"))
    found = F.coalesce("__relative", F.when(F.col("__hour").isNotNull(), full), F.col("__day").cast("timestamp"))
    at_time = F.when(word_in(t, "yesterday"), F.lit(None).cast("timestamp")).otherwise(found)
    return df.withColumn(name, at_time).drop(*_STEPS)


def parked(df: DataFrame, text: str, now: str, session: str, order: str, name: str = "at_time") -> DataFrame:
    """``df`` with ``name``, filled and parked: date-time answers over the turns of a session.

    An answer with a time fills the slot. One with a day alone parks that day, and is not filled; a later answer with
    a time and no day of its own is read on the parked day, from its midnight on. A filled slot clears the parked day.
    What an answer holds doesn't depend on the state, so the state is the last change before it: one window.
    """
    df = resolved(_parsed(df, text, now).withColumns({"__own": F.col("__day").isNotNull() | F.col("__relative").isNotNull(), "__timed": F.col("__at").isNotNull() | F.col("__period").isNotNull() | F.col("__relative").isNotNull()}).drop(*_STEPS), text, now, "__plain")
    found = F.col("__plain").isNotNull()
    change = F.when(found & F.col("__timed"), F.struct(F.lit(None).cast("date").alias("day"))).when(found, F.struct(F.to_date("__plain").alias("day")))
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__change", change).withColumn("__parked", F.last("__change", ignorenulls=True).over(w)["day"])
    later = ~F.col("__own") & F.col("__parked").isNotNull()
    df = df.withColumn("__from", F.when(later, F.col("__parked").cast("timestamp")).otherwise(F.col(now)))
    df = resolved(df, text, "__from", "__found").withColumns({"filled": F.coalesce(found & F.col("__timed"), F.lit(False)), "parked": F.when(found & ~F.col("__timed"), F.to_date("__plain")).when(~found, F.col("__parked"))})
    return df.withColumn(name, F.when(F.col("filled"), F.col("__found"))).drop("__own", "__timed", "__plain", "__change", "__parked", "__from", "__found")


# Words that dangle in front of a topic once its carrier and its time are gone.
CONNECTORS = ("for", "about", "of", "on", "to", "that", "regarding", "with")


def without_connector(t: Column, connectors: Sequence[str] = CONNECTORS) -> Column:
    """The topic without a leading connector, which may be all of it."""
    return F.regexp_replace(t, "^(" + "|".join(connectors) + ")( +|$)", "")


def utc_iso(c: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm'+00:00'")


LETTERS = "0-9A-Za-zÀ-ÿ_"
STRIPPED = (
    r"(?:in|for) +[0-9]+ *(?:minute|hour|day|week)s?", r"[0-9]{1,2}(?::[0-9]{2})? *(?:am|pm)", r"[0-9]{1,2}:[0-9]{2}", r"(?:at|by) +[0-9]{1,2}(?::[0-9]{2})?", r"(?:tomorrow|today|tonight)",
    r"(?:" + "|".join(WEEKDAYS) + r")s?", r"every +[a-z0-9_]+", r"(?:in +the +)?(?:morning|afternoon|evening|night|noon)", r"(?:at|on|by)",
)


def without_times(t: Column, patterns: Sequence[str] = STRIPPED) -> Column:
    t = F.replace(t, F.lit(" "), F.lit("  "))  # so that neighbours don't share the space between them
    for p in patterns:
        t = F.regexp_replace(t, f"(^|[^{LETTERS}])(?:{p})([^{LETTERS}]|$)", "$1$2")
    return F.trim(F.regexp_replace(t, " +", " "))
