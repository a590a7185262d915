"""Small files that a host writes: model heads, bundles, workbooks, capability trees. Each is read whole by one task.

Files come through Spark's own reader, so any file system will do. YAML needs the ``yaml`` module, and says so.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of a few megabytes at most, from the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(data))
    out.close()


def read_json_model(spark: SparkSession, path: str) -> DataFrame:
    """(label, w, b, temperature) of a weights file: labels, coef (a row for each label), intercept, temperature (1 without one)."""
    kind = "labels array<string>, coef array<array<double>>, intercept array<double>, temperature double"
    model = spark.read.schema(kind).json(path, multiLine=True)
    rows = F.explode(F.arrays_zip(F.col("labels").alias("label"), F.col("coef").alias("w"), F.col("intercept").alias("b"))).alias("x")
    return model.select(rows, F.coalesce("temperature", F.lit(1.0)).alias("temperature")).select("x.label", "x.w", "x.b", "temperature")


def read_npz_head(spark: SparkSession, path: str) -> DataFrame:
    """(label, w, b) of classifier heads saved by numpy: weights (a row for each label), bias, labels. Pickled arrays are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as head:
                    yield pd.DataFrame({"label": head["labels"].astype(str), "w": [w.astype(float).tolist() for w in head["weights"]], "b": head["bias"].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "label string, w array<double>, b double")


MANIFEST, TABLE, SIGNATURE = "bundle.json", "integrity/manifest.sha256", "integrity/signature.sig"


def bundle(files: dict[str, bytes], **facts: object) -> bytes:
    """A zip of ``files`` with a table of their digests and a manifest that holds the table's digest; without a signature."""
    table = "".join(f"{hashlib.sha256(data).hexdigest()}  {name}\n" for name, data in sorted(files.items())).encode()
    manifest = json.dumps({"format_version": "1.0", "checksums_root": hashlib.sha256(table).hexdigest()} | facts).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as zf:
        for name, data in {MANIFEST: manifest, TABLE: table, SIGNATURE: b"", **files}.items():
            zf.writestr(name, data)
    return out.getvalue()


def bundle_entries(content: bytes) -> list[tuple[str, str, str]]:
    """(name, sha256, issue) of each file of a bundle: ok, changed, unlisted or missing; a bad root or a lacking part spoils all."""
    with zipfile.ZipFile(io.BytesIO(content)) as zf:
        names = set(zf.namelist())
        if not {MANIFEST, TABLE, SIGNATURE} <= names:
            return [("", "", "incomplete")]
        table = zf.read(TABLE)
        if hashlib.sha256(table).hexdigest() != json.loads(zf.read(MANIFEST))["checksums_root"]:
            return [("", "", "root")]
        listed = {rel: digest for digest, rel in (line.split("  ", 1) for line in table.decode().splitlines())}
        found = {n: hashlib.sha256(zf.read(n)).hexdigest() for n in names - {MANIFEST, TABLE, SIGNATURE}}
    issue = lambda n: "missing" if n not in found else "unlisted" if n not in listed else "ok" if found[n] == listed[n] else "changed"
    return [(n, found.get(n, ""), issue(n)) for n in sorted(found.keys() | listed.keys())]


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, sha256, issue) of the entries of all bundles at ``path``, checked against their own tables."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(posixpath.basename(p), *entry) for p, content in zip(batch["path"], batch["content"], strict=True) for entry in bundle_entries(content)]
            yield pd.DataFrame(rows, columns=["file", "name", "sha256", "issue"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, name string, sha256 string, issue string")


# The namespaces and the few parts that a workbook must have.
_MAIN, _REL, _PACKAGE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"


def workbook(sheets: dict[str, Sequence[str]]) -> bytes:
    """A workbook with one column of texts on each sheet."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as zf:
        parts = [(f"xl/worksheets/sheet{i}.xml", name, rows) for i, (name, rows) in enumerate(sheets.items(), 1)]
        sheet_type, book_type = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
        overrides = "".join(f'<Override PartName="/{p}" ContentType="{sheet_type}"/>' for p, _, _ in parts)
        zf.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{book_type}"/>{overrides}</Types>')
        zf.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        zf.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (_, n, _) in enumerate(parts, 1)) + "</sheets></workbook>")
        zf.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(parts) + 1)) + "</Relationships>")
        for p, _, rows in parts:
            body = "".join(f'<row r="{r}"><c r="A{r}" t="inlineStr"><is><t xml:space="preserve">{escape(t)}</t></is></c></row>' for r, t in enumerate(rows, 1))
            zf.writestr(p, f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def sheet_texts(content: bytes) -> Iterator[tuple[str, int, str]]:
    """(sheet, row, text) of the cells in the first column of each sheet, blank ones left out."""
    tag, rel = lambda n: f"{{{_MAIN}}}{n}", f"{{{_REL}}}id"
    whole = lambda node: "".join(t.text or "" for t in node.iter(tag("t")))
    with zipfile.ZipFile(io.BytesIO(content)) as zf:
        shared = [whole(s) for s in ElementTree.fromstring(zf.read("xl/sharedStrings.xml")).findall(tag("si"))] if "xl/sharedStrings.xml" in zf.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(zf.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(zf.read("xl/workbook.xml")).iter(tag("sheet")):
            at = posixpath.normpath(posixpath.join("xl", targets[sheet.get(rel)])) if not targets[sheet.get(rel)].startswith("/") else targets[sheet.get(rel)][1:]
            for row in ElementTree.fromstring(zf.read(at)).iter(tag("row")):
                for cell in row.findall(tag("c")):
                    if (cell.get("r") or "A").rstrip("0123456789") == "A":
                        value = cell.findtext(tag("v")) or ""
                        text = whole(cell) if cell.get("t") == "inlineStr" else shared[int(value)] if cell.get("t") == "s" and value else value
                        if text.strip():
                            yield sheet.get("name"), int(row.get("r") or 0), text


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(text, intent, row) of workbooks whose sheets are labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(((text, sheet, row) for sheet, row, text in sheet_texts(content)), columns=["text", "intent", "row"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "text string, intent string, row int")


CAPABILITY = "intent string, capability string, action string, followup boolean, slots array<struct<name: string, entity: string, required: boolean>>"


def read_capabilities(spark: SparkSession, path: str) -> DataFrame:
    """Intents (``CAPABILITY``) of YAML files with one document for each intent, parted by ``---`` lines; each is a row, so files may be long."""
    try:
        import yaml  # noqa: F401
    except ImportError as e:
        raise ImportError("reading capability trees needs the yaml module") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for text in batch["value"]:
                cfg = yaml.safe_load(text)
                if cfg:
                    slots = [{"name": s.get("name"), "entity": s.get("entity"), "required": bool(s.get("required"))} for s in cfg.get("slots") or []]
                    rows.append((cfg.get("intent"), cfg.get("capability"), cfg.get("action"), bool(cfg.get("followup")), slots))
            yield pd.DataFrame(rows, columns=["intent", "capability", "action", "followup", "slots"])

    return spark.read.text(path, lineSep="---\n").mapInPandas(run, CAPABILITY)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report table as Markdown, from the driver: the first ``most`` rows in the order given."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])
