"""Content compiler and validation: catalogue tables in, compiled rows or diagnostics (code, location, what) out.

Intents have intent, capability, action, followup; slots have intent, slot, entity; triggers have intent, kind, terms.
All checks are joins, so a catalogue may be as large as any table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.rules import portability


def missing(df: DataFrame, refs: DataFrame, key: str, code: str, where: str) -> DataFrame:
    """Diagnostics for the rows of ``df`` whose reference isn't in ``refs``."""
    return df.join(refs.select(key).distinct(), key, "left_anti").select(F.lit(code).alias("code"), F.col(where).alias("location"), F.col(key).alias("what"))


def references(intents: DataFrame, slots: DataFrame, triggers: DataFrame, entities: DataFrame, actions: DataFrame, capabilities: DataFrame) -> DataFrame:
    """All references of a catalogue that lead nowhere."""
    found = [missing(slots, entities, "entity", "V3_ENTITY", "intent"), missing(intents, actions, "action", "V3_ACTION", "intent"), missing(intents, capabilities, "capability", "V4_CAPABILITY", "intent"), missing(triggers, intents, "intent", "V3_INTENT", "kind")]
    return reduce(DataFrame.unionByName, found)


def orphans(entities: DataFrame, slots: DataFrame) -> DataFrame:
    """(orphan): entities that no slot uses."""
    return entities.join(slots.select("entity").distinct(), "entity", "left_anti").select(F.col("entity").alias("orphan"))


def schema_map(files: DataFrame, schemas: Sequence[tuple[str, str]]) -> DataFrame:
    """(file, schemas, ok): how many of the (name, pattern) schemas claim each file; it should be one."""
    n = sum((F.col("file").rlike(rx).cast("long") for _, rx in schemas), F.lit(0).cast("long"))
    return files.select("file", n.alias("schemas"), (n == 1).alias("ok"))


def policy_verdicts(intents: DataFrame, policies: DataFrame) -> DataFrame:
    """(intent, verdict) against policies (intent, confirm): an intent with a follow-up must always confirm."""
    verdict = F.when(F.col("confirm").isNull(), "missing").when(F.col("followup") & (F.col("confirm") != "always"), "must_confirm").otherwise("ok")
    return intents.join(policies, "intent", "left").select("intent", verdict.alias("verdict"))


def label_parity(intents: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, verdict): intents without a model label, and labels without an intent."""
    both = intents.join(labels, F.col("intent") == F.col("label"), "full")
    verdict = F.when(F.col("label").isNull(), "no_label").when(F.col("intent").isNull(), "no_intent").otherwise("ok")
    return both.select(F.coalesce("intent", "label").alias("label"), verdict.alias("verdict"))


def untranslated(intents: DataFrame, languages: Sequence[str], prompts: DataFrame) -> DataFrame:
    """(lang, missing): intents without prompts (lang, intent) in one of the languages."""
    wanted = intents.select("intent", F.explode(F.array(*map(F.lit, languages))).alias("lang"))
    return wanted.join(prompts, ["lang", "intent"], "left_anti").select("lang", F.col("intent").alias("missing"))


def keywords(triggers: DataFrame) -> DataFrame:
    """(intent, tier, pattern): exact terms first, as whole texts; patterns and substrings after them."""
    rows = triggers.select("intent", "kind", F.explode("terms").alias("term"))
    exact = F.col("kind") == "exact"
    return rows.select("intent", F.when(exact, 1).otherwise(2).alias("tier"), F.when(exact, F.concat(F.lit("^"), "term", F.lit("$"))).otherwise(F.col("term")).alias("pattern"))


def policies(intents: DataFrame, bar: float = 0.5, followup_bar: float = 0.7) -> DataFrame:
    """(intent, confirm, bar): what an intent needs before it fires."""
    f = F.col("followup")
    return intents.select("intent", F.when(f, "always").otherwise("never").alias("confirm"), F.when(f, followup_bar).otherwise(bar).alias("bar"))


def guards(rows: DataFrame, intents: DataFrame) -> DataFrame:
    """(guard_id, verdict) of guards (guard_id, rx, blocked): the blocked intent must be known and the pattern portable."""
    known = intents.select(F.col("intent").alias("blocked"), F.lit(True).alias("known")).distinct()
    verdict = F.when(F.col("known").isNull(), "unknown_intent").when(F.size(portability(F.col("rx"))) > 0, "not_portable").otherwise("ok")
    return rows.join(known, "blocked", "left").select("guard_id", verdict.alias("verdict"))


def portable(rows: DataFrame, pattern: str = "rx") -> DataFrame:
    """The rows whose pattern is portable: what goes into a lexicon."""
    return rows.filter(F.size(portability(F.col(pattern))) == 0)


def overlaid(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """``base`` with ``value`` from ``over`` where that has the key; keys that only ``over`` has are left out."""
    return base.join(over.select(key, F.col(value).alias("__over")), key, "left").withColumn(value, F.coalesce("__over", value)).drop("__over")


def model_paths(models: DataFrame, places: Sequence[str] = ("pack", "build", "legacy")) -> DataFrame:
    """(lang, path): the first path by place of models (lang, place, path)."""
    return models.groupBy("lang").agg(F.coalesce(*(F.max(F.when(F.col("place") == p, F.col("path"))) for p in places)).alias("path"))


def pack_severity(models: DataFrame, channels: Sequence[str] = ("production", "dev")) -> DataFrame:
    """(channel, lang, absent, severity): a model that a pack lacks is an error in production and a warning elsewhere."""
    rows = models.filter("place = 'pack'").withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    absent = F.col("path").isNull()
    return rows.select("channel", "lang", absent.alias("absent"), F.when(absent & (F.col("channel") == "production"), "error").when(absent, "warning").otherwise("ok").alias("severity"))


def until_first_error(found: DataFrame, by: str) -> DataFrame:
    """Diagnostics (by, stage, severity, ...) up to the first stage of each ``by`` that has an error."""
    first = found.filter("severity = 'error'").groupBy(by).agg(F.min("stage").alias("__first"))
    return found.join(first, by, "left").filter(F.col("__first").isNull() | (F.col("stage") <= F.col("__first"))).drop("__first")


def sources_of(*tables: DataFrame, key: str = "intent") -> DataFrame:
    """(key, sources): how many rows of the tables make up each key of the assembled schema."""
    rows = reduce(DataFrame.unionByName, (t.select(key) for t in tables))
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("sources"))


def manifest_issues(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, issue): MISSING, EXTRA or CHANGED entries of two manifests."""
    both = expected.select(key, F.col(digest).alias("__want")).join(actual.select(key, F.col(digest).alias("__got")), key, "full")
    issue = F.when(F.col("__got").isNull(), "MISSING").when(F.col("__want").isNull(), "EXTRA").otherwise("CHANGED")
    return both.filter(~F.col("__want").eqNullSafe(F.col("__got"))).select(key, issue.alias("issue"))
