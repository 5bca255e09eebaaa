"""Files as tables: workbooks, CSV, DOCX and text, read through the binary-file source.

Contents come through Spark's ``binaryFile`` source, so any file system that Spark
reads will do, and each file is parsed where it is read. What cannot be read becomes a
row with its reason, never an exception.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.operators.formulas import column_number

CELLS = "file string, sheet_index int, sheet_name string, row int, col int, value string, formula string, number_as_text boolean"
SHEETS = "file string, sheet_index int, sheet_name string, state string, n_rows int, n_cols int, merged array<string>, hidden_rows array<int>, hidden_cols array<int>, filter_ref string"
PARAGRAPHS = "file string, index int, text string"
REPORT = "file string, kind string, status string, reason string, n_records bigint"
#: A file larger than this is not parsed but reported, by :func:`parse_report`.
MOST_BYTES = 512 * 1024 * 1024

# Name spaces of the file formats.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# First bytes of the formats that are told apart.
MAGIC = {b"PK\x03\x04": "zip", b"%PDF": "pdf", b"\xd0\xcf\x11\xe0": "ole"}


def file_kind(name: str, head: bytes) -> tuple[str, str]:
    """(kind, status) of a file by suffix and first bytes: ``ok``, ``unsupported`` or ``mismatch``."""
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    magic = next((kind for b, kind in MAGIC.items() if head.startswith(b)), "text")
    wanted = {"xlsx": "zip", "xlsm": "zip", "docx": "zip", "csv": "text", "txt": "text", "pdf": "pdf", "xls": "ole"}.get(suffix)
    if wanted is None:
        return suffix or "none", "unsupported"
    if wanted != magic:
        return suffix, "mismatch"
    return suffix, "unsupported" if suffix in ("pdf", "xls") else "ok"


def intake(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, status, size and SHA-256 of every file below a path; content is hashed, not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.pandas_udf(lambda p, h: pd.DataFrame([file_kind(a, bytes(b)) for a, b in zip(p, h, strict=True)], columns=["kind", "status"]), "kind string, status string")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), kind("path", F.substring("content", 1, 8)).alias("k")).select("path", "length", "sha256", "k.kind", "k.status")


def distinct_files(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per content (and further keys): the first path, and how many copies there are."""
    return files.groupBy(*keys, "sha256").agg(F.min("path").alias("path"), F.count("*").alias("n_copies"))


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.parse(f).getroot().iter(f"{_MAIN}si")]


def _sheet_parts(z: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    """(name, state, part) of each sheet in order."""
    targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets.get(s.get(f"{_REL}id"), "")
        out.append((s.get("name", ""), s.get("state", "visible"), target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)))
    return out


def _cell_value(c: ET.Element, strings: list[str]) -> str | None:
    kind, v = c.get("t"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return strings[int(v.text)]
    return v.text


_NUMBER = re.compile(r"^\s*-?[\d,]*\.?\d+\s*$")


def workbook_cells(content: bytes) -> Iterator[tuple[int, str, int, int, str | None, str | None, bool]]:
    """(sheet index, sheet name, row, column, value, formula, number stored as text) of every filled cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = _shared_strings(z)
        for index, (name, _, part) in enumerate(_sheet_parts(z)):
            with z.open(part) as f:
                for _, e in ET.iterparse(f):
                    if e.tag != f"{_MAIN}row":
                        continue
                    for c in e.iter(f"{_MAIN}c"):
                        m = re.match(r"([A-Z]+)(\d+)", c.get("r", ""))
                        value, formula = _cell_value(c, strings), c.find(f"{_MAIN}f")
                        text = "=" + formula.text if formula is not None and formula.text else None
                        if m and (value not in (None, "") or text):
                            yield index, name, int(m[2]), column_number(m[1]), value, text, c.get("t") in ("s", "inlineStr", "str") and bool(value and _NUMBER.match(value))
                    e.clear()


def workbook_sheets(content: bytes) -> Iterator[tuple]:
    """(index, name, state, rows, columns, merged ranges, hidden rows, hidden columns, filter) of every sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for index, (name, state, part) in enumerate(_sheet_parts(z)):
            rows = cols = 0
            merged, hidden_rows, hidden_cols, filter_ref = [], [], [], None
            with z.open(part) as f:
                for _, e in ET.iterparse(f):
                    tag = e.tag.removeprefix(_MAIN)
                    if tag == "row":
                        at = int(e.get("r", rows + 1))
                        rows = max(rows, at)
                        if e.get("hidden") in ("1", "true"):
                            hidden_rows.append(at)
                        for c in e.iter(f"{_MAIN}c"):
                            if m := re.match(r"([A-Z]+)", c.get("r", "")):
                                cols = max(cols, column_number(m[1]))
                        e.clear()
                    elif tag == "mergeCell":
                        merged.append(e.get("ref"))
                    elif tag == "col" and e.get("hidden") in ("1", "true"):
                        hidden_cols += list(range(int(e.get("min", 1)), int(e.get("max", 1)) + 1))
                    elif tag == "autoFilter":
                        filter_ref = e.get("ref")
            yield index, name, state, rows, cols, merged, hidden_rows, hidden_cols, filter_ref


def csv_cells(content: bytes) -> Iterator[tuple[int, str, int, int, str | None, str | None, bool]]:
    """As :func:`workbook_cells`, of a CSV file; empty cells are left out."""
    text = content.decode("utf-8-sig", "replace")
    for r, row in enumerate(csv.reader(io.StringIO(text)), 1):
        for c, value in enumerate(row, 1):
            if value != "":
                yield 0, "csv", r, c, value, None, bool(_NUMBER.match(value))


def docx_paragraphs(content: bytes) -> Iterator[str]:
    """Paragraphs and table rows (cells joined by " | ") of a document, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t")).strip()
    for e in body if body is not None else ():
        if e.tag == f"{_WORD}p" and text(e):
            yield text(e)
        elif e.tag == f"{_WORD}tbl":
            for row in e.iter(f"{_WORD}tr"):
                cells = [text(c) for c in row.iter(f"{_WORD}tc")]
                if any(cells):
                    yield " | ".join(cells)


#: What a broken file raises.
_BROKEN = (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError, EOFError, NotImplementedError)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _parsed(spark: SparkSession, path: str, parse, schema: str, columns: list[str]) -> DataFrame:
    files = _files(spark, path).filter(F.col("length") <= MOST_BYTES).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(file, *r) for r in parse(file, bytes(content))]
                except _BROKEN:
                    rows = []
                yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, schema)


def parse_report(spark: SparkSession, path: str) -> DataFrame:
    """One row for every file below a path: kind, status, reason and number of records, whether it could be read or not.

    Status: ``ok``, ``empty`` (read, but without records), ``partial`` (some records
    before the file broke), ``broken``, ``too large``, ``unsupported`` or ``mismatch``.
    The readers leave out what is neither ok nor partial; of a partial file they take
    nothing, so that no file is half in a table. Files of no bytes are not listed by Spark.
    """

    def records(kind: str, content: bytes):
        if kind in ("xlsx", "xlsm"):
            return workbook_cells(content)
        if kind == "csv":
            return csv_cells(content)
        if kind == "docx":
            return docx_paragraphs(content)
        return iter(content.decode("utf-8-sig").splitlines())

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                content = bytes(content)
                kind, status = file_kind(file, content[:8])
                n, reason = 0, None
                if status == "ok":
                    try:
                        for _ in records(kind, content):
                            n += 1
                        status = "ok" if n else "empty"
                    except _BROKEN as e:
                        status, reason = "partial" if n else "broken", type(e).__name__
                rows.append((file, kind, status, reason, n))
            yield pd.DataFrame(rows, columns=_names(REPORT))

    files = _files(spark, path)
    large = files.filter(F.col("length") > MOST_BYTES).select(
        F.col("path").alias("file"), F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1)).alias("kind"), F.lit("too large").alias("status"), F.concat("length", F.lit(f" of {MOST_BYTES} bytes")).alias("reason"), F.lit(0).cast("bigint").alias("n_records")
    )
    return files.filter(F.col("length") <= MOST_BYTES).select("path", "content").mapInPandas(judge, REPORT).unionByName(large)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All filled cells of the workbooks and CSV files below a path; other and broken files have none."""

    def parse(file: str, content: bytes):
        kind, status = file_kind(file, content[:8])
        if status == "ok" and kind in ("xlsx", "xlsm"):
            yield from workbook_cells(content)
        elif status == "ok" and kind == "csv":
            yield from csv_cells(content)

    return _parsed(spark, path, parse, CELLS, _names(CELLS))


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Structure of every worksheet: size, state, merged ranges, hidden rows and columns, filter."""

    def parse(file: str, content: bytes):
        kind, status = file_kind(file, content[:8])
        if status == "ok" and kind in ("xlsx", "xlsm"):
            yield from workbook_sheets(content)

    return _parsed(spark, path, parse, SHEETS, _names(SHEETS))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of documents and lines of text files, numbered from 1."""

    def parse(file: str, content: bytes):
        kind, status = file_kind(file, content[:8])
        if status == "ok" and kind == "docx":
            yield from enumerate(docx_paragraphs(content), 1)
        elif status == "ok" and kind == "txt":
            lines = (x.strip() for x in content.decode("utf-8-sig", "replace").splitlines())
            yield from ((i, x) for i, x in enumerate(lines, 1) if x)

    return _parsed(spark, path, parse, PARAGRAPHS, _names(PARAGRAPHS))


def effective_grid(cells: DataFrame) -> DataFrame:
    """sheet_id, row, col, value: the cached value of formulas, the own value of other cells; blanks dropped."""
    sheet = F.concat_ws("#", "file", "sheet_index")
    return cells.select(sheet.alias("sheet_id"), "row", "col", "value").filter(F.col("value").isNotNull() & (F.trim("value") != ""))


def formula_states(cells: DataFrame) -> DataFrame:
    """Cells by state of their formula: not_formula, missing (no cached value), error, opaque or cached."""
    opaque = F.col("formula").rlike("(?i)\\b(INDIRECT|OFFSET|INDEX|CHOOSE)\\s*\\(")
    state = F.when(F.col("formula").isNull(), "not_formula").when(F.col("value").isNull(), "missing").when(F.col("value").startswith("#"), "error").when(opaque, "opaque").otherwise("cached")
    return cells.withColumn("state", state)


def census(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Sheets as two readers saw them: same, differs, or seen by one only."""
    seen = cells.groupBy("file", "sheet_index").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    j = seen.join(sheets.select("file", "sheet_index", "n_rows", "n_cols"), ["file", "sheet_index"], "full")
    state = F.when(F.col("rows").isNull(), "empty").when(F.col("n_rows").isNull(), "extra").when((F.col("rows") == F.col("n_rows")) & (F.col("cols") == F.col("n_cols")), "same").otherwise("differs")
    return j.select("file", "sheet_index", state.alias("state"))


def covered_cells(sheets: DataFrame) -> DataFrame:
    """Every cell that a merged range covers, with the range's first cell."""
    ref = F.explode("merged").alias("ref")
    number = lambda x: F.aggregate(F.split(F.nullif(x, F.lit("")), ""), F.lit(0), lambda n, ch: n * 26 + F.ascii(ch) - 64)
    r = sheets.select("file", "sheet_index", ref).select(
        "file", "sheet_index", number(F.regexp_extract("ref", "^([A-Z]+)", 1)).alias("c1"), F.regexp_extract("ref", "^[A-Z]+([0-9]+)", 1).cast("int").alias("r1"), number(F.regexp_extract("ref", ":([A-Z]+)", 1)).alias("c2"), F.regexp_extract("ref", ":[A-Z]+([0-9]+)", 1).cast("int").alias("r2")
    )
    rows = r.select("*", F.explode(F.sequence("r1", "r2")).alias("row"))
    return rows.select("file", "sheet_index", "row", F.explode(F.sequence("c1", "c2")).alias("col"), F.col("r1").alias("anchor_row"), F.col("c1").alias("anchor_col"))


def assess_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """State of each declared entry (entry, sha256, path): present, mismatch, missing, ambiguous or unbound."""
    by_sha = files.groupBy("sha256").agg(F.count_distinct("path").alias("_n"))
    by_path = files.select(F.col("path"), F.col("sha256").alias("_found")).dropDuplicates(["path"])
    j = manifest.join(by_sha, "sha256", "left").join(by_path, "path", "left")
    state = (
        F.when(F.col("sha256").isNull() & F.col("path").isNull(), "unbound")
        .when(F.col("_n") > 1, "ambiguous")
        .when(F.col("_n") == 1, "present")
        .when(F.col("_found").isNotNull() & F.col("sha256").isNotNull(), "mismatch")
        .when(F.col("_found").isNotNull(), "present")
        .otherwise("missing")
    )
    return j.select("entry", state.alias("state"))


def compare_readers(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Fields in which two readers disagree about a sheet, or sheets that one of them lacks; a report, nothing more."""
    fields = [c for c in first.columns if c not in keys and c in second.columns]
    side = lambda df, p: df.select(*keys, *[F.col(c).cast("string").alias(f"{p}_{c}") for c in fields], F.lit(True).alias(f"_{p}"))
    j = side(first, "a").join(side(second, "b"), keys, "full")
    each = F.explode(F.array(F.struct(F.lit("sheet").alias("field"), F.when(F.col("_a").isNull(), "missing").alias("a"), F.when(F.col("_b").isNull(), "missing").alias("b")), *[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in fields])).alias("f")
    rows = j.select(*keys, each, (F.col("_a").isNull() | F.col("_b").isNull()).alias("_alone")).select(*keys, "f.*", "_alone")
    return rows.filter(~F.col("a").eqNullSafe(F.col("b")) & (~F.col("_alone") | (F.col("field") == "sheet"))).drop("_alone")


def read_directions(files: DataFrame, categories: DataFrame) -> DataFrame:
    """Files with the category, direction and strategy of the intake catalogue; unknown ones are unclassified."""
    j = files.join(categories, "category", "left")
    return j.select("path", F.coalesce("direction", F.lit("unknown")).alias("direction"), F.coalesce("strategy", F.lit("unclassified")).alias("strategy"))


def line_numbers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of a text column, numbered from 1."""
    return texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_i", "line")).select(key, (F.col("_i") + 1).alias("line_no"), "line")
