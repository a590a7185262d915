"""Content compiler and validation queries. The parts are the intents of a catalogue, their brands its capabilities."""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import content as K
from brindle.operators import corpus as C
from brindle.operators import scoring as S
from brindle.plans import oracle as O
from brindle.plans.catalog import query
from brindle.plans.files import folder
from brindle.plans.scoring import IN_SCOPE, MODEL, vectors
from brindle.sources import host_files as H
from brindle.sources.tables import inline, table, values

_I = "(SELECT 'part.' || p_partkey AS intent, p_brand AS capability, p_type AS action, p_size > 25 AS followup FROM part)"
_S = "(SELECT 'part.' || p_partkey AS intent, split_part(p_name, ' ', 1) AS slot, split_part(p_name, ' ', 2) AS entity FROM part WHERE p_partkey % 3 <> 0)"
_TR = "(SELECT 'part.' || (p_partkey * 2) AS intent, CASE p_partkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' ELSE 'regex' END AS kind, [p_name, p_brand] AS terms FROM part)"
_EN = "(SELECT DISTINCT entity FROM (SELECT split_part(p_name, ' ', 2) AS entity FROM part WHERE p_size < 40 UNION ALL SELECT p_type FROM part) WHERE entity NOT IN ('ring', 'widget'))"
_A, _C = "(SELECT DISTINCT p_type AS action FROM part WHERE p_type <> 'PROMO')", "(SELECT DISTINCT p_brand AS capability FROM part WHERE p_brand NOT LIKE '%7')"


def intents(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.concat(F.lit("part."), "p_partkey").alias("intent"), F.col("p_brand").alias("capability"), F.col("p_type").alias("action"), (F.col("p_size") > 25).alias("followup"))


def slots(spark, sf) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, sf, "part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("part."), "p_partkey").alias("intent"), F.get(words, F.lit(0)).alias("slot"), F.get(words, F.lit(1)).alias("entity"))


def triggers(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "exact").when(k % 3 == 1, "contains").otherwise("regex")
    return table(spark, sf, "part").select(F.concat(F.lit("part."), (k * 2).cast("string")).alias("intent"), kind.alias("kind"), F.array("p_name", "p_brand").alias("terms"))


def entities(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    found = p.filter("p_size < 40").select(F.get(F.split("p_name", " "), F.lit(1)).alias("entity")).union(p.select("p_type"))
    return found.filter(~F.col("entity").isin("ring", "widget")).distinct()


def written_catalogue(spark, sf) -> str:
    """The intents and slots of the tables as a YAML tree: its folder."""
    path = folder(spark, "capabilities")
    rows = intents(spark, sf).join(slots(spark, sf), "intent", "left")
    slot = F.when(F.col("slot").isNotNull(), F.concat(F.lit("\nslots:\n- name: "), "slot", F.lit("\n  entity: "), "entity", F.lit("\n  required: true"))).otherwise("")
    rows.select(F.concat(F.lit("---\nintent: "), "intent", F.lit("\ncapability: "), "capability", F.lit("\naction: "), "action", F.lit("\nfollowup: "), F.col("followup").cast("string"), slot).alias("value")).write.text(path)
    return path


@query(f"SELECT i.intent, capability, action, followup, slot, entity FROM {_I} i LEFT JOIN {_S} s ON i.intent = s.intent")
def scan_yaml_caps(spark, sf):
    read = H.read_capabilities(spark, written_catalogue(spark, sf))
    return read.select("intent", "capability", "action", "followup", F.explode_outer("slots").alias("s")).select("intent", "capability", "action", "followup", F.col("s.name").alias("slot"), F.col("s.entity").alias("entity"))


@query(f"SELECT 'V3_ENTITY' AS code, intent AS location, entity AS what FROM {_S} WHERE entity NOT IN (FROM {_EN}) UNION ALL SELECT 'V3_ACTION', intent, action FROM {_I} WHERE action NOT IN (FROM {_A}) UNION ALL SELECT 'V4_CAPABILITY', intent, capability FROM {_I} WHERE capability NOT IN (FROM {_C}) UNION ALL SELECT 'V3_INTENT', kind, intent FROM {_TR} WHERE intent NOT IN (SELECT intent FROM {_I})")
def ref_resolution(spark, sf):
    """References of the catalogue as read back from its YAML tree."""
    read = H.read_capabilities(spark, written_catalogue(spark, sf))
    read_slots = read.select("intent", F.inline("slots")).select("intent", F.col("name").alias("slot"), "entity")
    p = table(spark, sf, "part")
    actions = p.filter("p_type <> 'PROMO'").select(F.col("p_type").alias("action"))
    capabilities = p.filter("p_brand not like '%7'").select(F.col("p_brand").alias("capability"))
    return K.references(read.drop("slots"), read_slots, triggers(spark, sf), entities(spark, sf), actions, capabilities)


@query(f"SELECT entity AS orphan FROM {_EN} WHERE entity NOT IN (SELECT entity FROM {_S})")
def v4_orphans(spark, sf):
    return K.orphans(entities(spark, sf), slots(spark, sf))


_FILES = "(SELECT CASE p_partkey % 5 WHEN 0 THEN 'intents/' || p_partkey || '.json' WHEN 1 THEN 'policy.json' WHEN 2 THEN p_name || '.txt' WHEN 3 THEN 'prompts/' || p_partkey || '.json' ELSE 'manifest.json' END AS file FROM part)"
SCHEMAS = [("intent", "^intents/.*[.]json$"), ("policy", "^policy[.]json$"), ("any", "^p.*json$"), ("manifest", "^manifest[.]json$")]


@query(f"SELECT file, count(rx)::BIGINT AS schemas, count(rx) = 1 AS ok FROM (SELECT row_number() OVER () AS n, file FROM {_FILES}) LEFT JOIN {values('name, rx', SCHEMAS)} ON regexp_matches(file, rx) GROUP BY n, file")
def v1_schema_map(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_partkey").cast("string")
    file = F.when(k % 5 == 0, F.concat(F.lit("intents/"), name, F.lit(".json"))).when(k % 5 == 1, "policy.json").when(k % 5 == 2, F.concat("p_name", F.lit(".txt"))).when(k % 5 == 3, F.concat(F.lit("prompts/"), name, F.lit(".json"))).otherwise("manifest.json")
    return K.schema_map(table(spark, sf, "part").select(file.alias("file")), SCHEMAS)


@query(f"SELECT i.intent, CASE WHEN p.confirm IS NULL THEN 'missing' WHEN i.followup AND p.confirm <> 'always' THEN 'must_confirm' ELSE 'ok' END AS verdict FROM {_I} i LEFT JOIN (SELECT 'part.' || p_partkey AS intent, CASE WHEN p_partkey % 2 = 0 THEN 'always' ELSE 'never' END AS confirm FROM part WHERE p_partkey % 9 <> 0) p USING (intent)")
def v5_policy(spark, sf):
    k = F.col("p_partkey")
    given = table(spark, sf, "part").filter(k % 9 != 0).select(F.concat(F.lit("part."), "p_partkey").alias("intent"), F.when(k % 2 == 0, "always").otherwise("never").alias("confirm"))
    return K.policy_verdicts(intents(spark, sf), given)


@query(f"SELECT coalesce(i.intent, l.label) AS label, CASE WHEN l.label IS NULL THEN 'no_label' WHEN i.intent IS NULL THEN 'no_intent' ELSE 'ok' END AS verdict FROM {_I} i FULL JOIN (SELECT 'part.' || (p_partkey * 3) AS label FROM part) l ON i.intent = l.label")
def v8_parity(spark, sf):
    return K.label_parity(intents(spark, sf), table(spark, sf, "part").select(F.concat(F.lit("part."), (F.col("p_partkey") * 3).cast("string")).alias("label")))


@query(f"WITH l AS (SELECT unnest(['en', 'fr', 'de']) AS lang), k AS (SELECT 'part.' || p_partkey AS intent, unnest(CASE WHEN p_partkey % 4 = 0 THEN ['en'] ELSE ['en', 'fr'] END) AS lang FROM part) SELECT lang, intent AS missing FROM l, {_I} i WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.lang = l.lang AND k.intent = i.intent)")
def v9_localization(spark, sf):
    there = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("en"))).otherwise(F.array(F.lit("en"), F.lit("fr")))
    prompts = table(spark, sf, "part").select(F.concat(F.lit("part."), "p_partkey").alias("intent"), F.explode(there).alias("lang"))
    return K.untranslated(intents(spark, sf), ("en", "fr", "de"), prompts)


@query(f"SELECT intent, CASE WHEN kind = 'exact' THEN 1 ELSE 2 END AS tier, CASE WHEN kind = 'exact' THEN '^' || unnest(terms) || '$' ELSE unnest(terms) END AS pattern FROM {_TR}")
def keywords_compile(spark, sf):
    return K.keywords(triggers(spark, sf))


@query(f"SELECT intent, CASE WHEN followup THEN 'always' ELSE 'never' END AS confirm, CASE WHEN followup THEN 0.7 ELSE 0.5 END::DOUBLE AS bar FROM {_I}")
def policies_compile(spark, sf):
    return K.policies(intents(spark, sf))


_G = "(SELECT p_partkey AS guard_id, CASE p_partkey % 4 WHEN 0 THEN '(?=' || p_name || ')' WHEN 1 THEN p_name || '{2,40}' ELSE p_name END AS rx, 'part.' || (p_partkey * 2) AS blocked FROM part)"
_BAD = "(contains(rx, '(?=') OR contains(rx, '{2,40}'))"


def guard_rows(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    rx = F.when(k % 4 == 0, F.concat(F.lit("(?="), "p_name", F.lit(")"))).when(k % 4 == 1, F.concat("p_name", F.lit("{2,40}"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(k.alias("guard_id"), rx.alias("rx"), F.concat(F.lit("part."), (k * 2).cast("string")).alias("blocked"))


@query(f"SELECT guard_id, CASE WHEN blocked NOT IN (SELECT intent FROM {_I}) THEN 'unknown_intent' WHEN {_BAD} THEN 'not_portable' ELSE 'ok' END AS verdict FROM {_G}")
def guards_compile(spark, sf):
    return K.guards(guard_rows(spark, sf), intents(spark, sf))


@query(f"SELECT guard_id, rx FROM {_G} WHERE NOT {_BAD}")
def lexicon_compile(spark, sf):
    return K.portable(guard_rows(spark, sf)).select("guard_id", "rx")


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'fr ' || p_name ELSE p_name END AS text, p_type AS shape FROM part")
def overlay_merge(spark, sf):
    p = table(spark, sf, "part")
    base = p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text"), F.col("p_type").alias("shape"))
    over = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.concat(F.lit("fr "), "p_name").alias("text")).union(inline(spark, "key long, text string", [(-1, "extra")]))
    return K.overlaid(base, over, "key", "text")


@query(O.rooted("SELECT p_brand AS brand, sha256(sha256(p_name) || '  ' || p_partkey::VARCHAR) AS d FROM part", "brand", "brand, n, root"))
def hash_table(spark, sf):
    line = F.concat(F.sha2("p_name", 256), F.lit("  "), F.col("p_partkey").cast("string"))
    return C.rooted(table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.sha2(line, 256).alias("d")), "brand", "d")


@query("WITH e AS (SELECT p_partkey AS k, md5(p_name) AS h FROM part WHERE p_partkey % 50 <> 0), a AS (SELECT p_partkey AS k, md5(CASE WHEN p_partkey % 40 = 0 THEN 'x' ELSE p_name END) AS h FROM part WHERE p_partkey % 60 <> 0) SELECT coalesce(e.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'MISSING' WHEN e.k IS NULL THEN 'EXTRA' ELSE 'CHANGED' END AS issue FROM e FULL JOIN a USING (k) WHERE e.h IS DISTINCT FROM a.h")
def manifest_verify(spark, sf):
    p = table(spark, sf, "part")
    e = p.filter("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("k"), F.md5("p_name").alias("h"))
    a = p.filter("p_partkey % 60 <> 0").select(F.col("p_partkey").alias("k"), F.md5(F.when(F.col("p_partkey") % 40 == 0, "x").otherwise(F.col("p_name"))).alias("h"))
    return K.manifest_issues(e, a, "k", "h")


_MODELS = "(SELECT p_brand AS lang, CASE p_partkey % 3 WHEN 0 THEN 'pack' WHEN 1 THEN 'build' ELSE 'legacy' END AS place, CASE WHEN p_size > 10 THEN p_name END AS path FROM part)"


def models(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    place = F.when(k % 3 == 0, "pack").when(k % 3 == 1, "build").otherwise("legacy")
    return table(spark, sf, "part").select(F.col("p_brand").alias("lang"), place.alias("place"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("path"))


@query(f"SELECT lang, coalesce(max(path) FILTER (place = 'pack'), max(path) FILTER (place = 'build'), max(path) FILTER (place = 'legacy')) AS path FROM {_MODELS} GROUP BY lang")
def model_resolution(spark, sf):
    return K.model_paths(models(spark, sf))


@query(f"SELECT channel, lang, path IS NULL AS absent, CASE WHEN path IS NULL AND channel = 'production' THEN 'error' WHEN path IS NULL THEN 'warning' ELSE 'ok' END AS severity FROM {_MODELS}, {values('channel', [('production',), ('dev',)])} WHERE place = 'pack'")
def pack_load(spark, sf):
    return K.pack_severity(models(spark, sf))


_FOUND = "(SELECT p_brand AS pack, p_partkey % 9 AS stage, CASE WHEN p_size > 30 AND p_partkey % 9 > 3 THEN 'error' ELSE 'warning' END AS severity, p_partkey AS code FROM part)"


@query(f"WITH d AS {_FOUND} SELECT pack, stage, code FROM d WHERE stage <= coalesce((SELECT min(stage) FROM d e WHERE e.pack = d.pack AND severity = 'error'), 99)")
def stage1_shortcircuit(spark, sf):
    stage = F.col("p_partkey") % 9
    found = table(spark, sf, "part").select(F.col("p_brand").alias("pack"), stage.alias("stage"), F.when((F.col("p_size") > 30) & (stage > 3), "error").otherwise("warning").alias("severity"), F.col("p_partkey").alias("code"))
    return K.until_first_error(found, "pack").select("pack", "stage", "code")


@query(f"SELECT key, count(*)::BIGINT AS sources FROM (SELECT intent AS key FROM {_I} UNION ALL SELECT intent FROM {_S}) GROUP BY key")
def assemble_schema(spark, sf):
    return K.sources_of(intents(spark, sf), slots(spark, sf))


# files that a host writes


@query("SELECT r_name || '.txt' AS name, sha256(r_name) AS sha256, CASE WHEN r_regionkey = 0 THEN 'changed' WHEN r_regionkey = 1 THEN 'unlisted' ELSE 'ok' END AS issue FROM region UNION ALL SELECT 'gone.txt', '', 'missing'")
def scan_zip_bundle(spark, sf):
    """The regions as a bundle of files, one of them changed, one not listed and one lacking."""
    import zipfile

    rows = table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()  # five rows
    listed = {f"{r.r_name}.txt": b"other" if r.r_regionkey == 0 else r.r_name.encode() for r in rows if r.r_regionkey != 1} | {"gone.txt": b""}
    signed, out = io.BytesIO(H.bundle(listed)), io.BytesIO()
    with zipfile.ZipFile(signed) as before, zipfile.ZipFile(out, "w") as after:
        for name in (H.MANIFEST, H.TABLE, H.SIGNATURE):
            after.writestr(name, before.read(name))
        for r in rows:
            after.writestr(f"{r.r_name}.txt", r.r_name)
    path = f"{folder(spark, 'bundles')}/content.zip"
    H.write_bytes(spark, path, out.getvalue())
    return H.read_bundles(spark, path).select("name", "sha256", "issue")


def _head(spark, sf) -> list:
    """One row for each in-scope label."""
    return S.prototypes(vectors(spark, sf).filter(F.col("gold") < IN_SCOPE), "v", "gold").orderBy("label").collect()


_WEIGHTS = f"WITH {MODEL} SELECT label::VARCHAR AS label, round(w[1], 6) AS w1, round(list_sum(w), 6) AS total, label / 10::DOUBLE AS b"


@query(f"{_WEIGHTS}, 0.5::DOUBLE AS temperature FROM model")
def scan_json_model(spark, sf):
    head = _head(spark, sf)
    path = f"{folder(spark, 'model')}/weights.json"
    H.write_bytes(spark, path, json.dumps({"labels": [str(r.label) for r in head], "coef": [r.w for r in head], "intercept": [r.label / 10 for r in head], "temperature": 0.5}, indent=1).encode())
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return H.read_json_model(spark, path).select("label", F.round(F.get("w", F.lit(0)), 6).alias("w1"), F.round(total, 6).alias("total"), "b", "temperature")


@query(f"{_WEIGHTS} FROM model")
def scan_npz_head(spark, sf):
    head, out = _head(spark, sf), io.BytesIO()
    np.savez(out, labels=np.array([str(r.label) for r in head]), weights=np.array([r.w for r in head]), bias=np.array([r.label / 10 for r in head]))
    path = f"{folder(spark, 'head')}/head.npz"
    H.write_bytes(spark, path, out.getvalue())
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return H.read_npz_head(spark, path).select("label", F.round(F.get("w", F.lit(0)), 6).alias("w1"), F.round(total, 6).alias("total"), "b")


@query("SELECT n_name AS text, r_name AS intent, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey)::INT AS row FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_xlsx_sheets(spark, sf):
    """The nations as a workbook with a sheet for each region."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()  # 25 rows
    sheets: dict[str, list[str]] = {}
    for r in rows:
        sheets.setdefault(r.r_name, []).append(r.n_name)
    path = f"{folder(spark, 'book')}/nations.xlsx"
    H.write_bytes(spark, path, H.workbook(sheets))
    return H.read_workbooks(spark, path)


@query("SELECT unnest(['| r_regionkey | r_name |', '|---|---|'] || (SELECT list('| ' || r_regionkey || ' | ' || r_name || ' |' ORDER BY r_regionkey) FROM region)) AS line")
def sink_markdown(spark, sf):
    path = f"{folder(spark, 'report')}/regions.md"
    H.write_bytes(spark, path, H.markdown(table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")).encode())
    return spark.read.text(path).select(F.col("value").alias("line"))
