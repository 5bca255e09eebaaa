"""Results written: registered tables, upserts by partition, workbooks and CSV."""

from __future__ import annotations

import datetime
import json
import os
import zipfile
from collections.abc import Mapping
from decimal import Decimal
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.operators.lineage import table_digest

#: Rows that a worksheet can hold.
SHEET_ROWS = 1_048_576


def write_registered(df: DataFrame, base: str, kind: str, signature: str) -> str:
    """Write a result as parquet under a name of its own and register it; older ones of its kind become stale.

    The table is written first and registered afterwards, by one row appended to
    ``base/_register``; a write that dies leaves no registered result.
    """
    spark = df.sparkSession
    stamp = datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%S%f")
    path = f"{base}/{kind}/{stamp}"
    df.write.mode("errorifexists").parquet(path)
    digest = table_digest(spark.read.parquet(path), kind).withColumn("path", F.lit(path)).withColumn("signature", F.lit(signature)).withColumn("written_at", F.lit(stamp))
    digest.coalesce(1).write.mode("append").parquet(f"{base}/_register")
    return path


def registered(spark: SparkSession, base: str) -> DataFrame:
    """The register, with ``current`` for the newest result of each kind."""
    rows = spark.read.parquet(f"{base}/_register")
    newest = rows.groupBy("component").agg(F.max("written_at").alias("_n"))
    return rows.join(newest, "component").withColumn("current", F.col("written_at") == F.col("_n")).drop("_n")


def upsert_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that ``df`` has rows for and leave the others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; missing values stay empty and are never zero."""
    df.write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(row: int, col: int, value) -> str:
    at = f'r="{_letters(col)}{row}"'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c {at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)):
        return f"<c {at}><v>{value}</v></c>"
    if isinstance(value, str) and value.startswith("="):
        return f"<c {at}><f>{escape(value[1:])}</f></c>"
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def export_workbook(sheets: Mapping[str, DataFrame], path: str) -> None:
    """One worksheet per table, streamed row by row through the driver; reports only, a sheet holds SHEET_ROWS rows.

    A table that does not fit raises instead of being cut. The file appears under its
    name only when it is complete.
    """
    temporary = f"{path}.part"
    names = list(sheets)
    with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, name in enumerate(names, 1):
            df = sheets[name]
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                f.write(("<row r=\"1\">" + "".join(_cell(1, c, n) for c, n in enumerate(df.columns, 1)) + "</row>").encode())
                for r, row in enumerate(df.toLocalIterator(), 2):
                    if r > SHEET_ROWS:
                        raise ValueError(f"{name} has more rows than a worksheet holds")
                    f.write((f'<row r="{r}">' + "".join(_cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
    os.replace(temporary, path)


def export_markdown(df: DataFrame, title: str) -> str:
    """A short table as Markdown, for summaries (a hundred rows at most)."""
    rows = df.limit(101).collect()
    if len(rows) > 100:
        raise ValueError("a summary table has a hundred rows at most")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"## {title}", "", line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows], ""])


def acceptance_bundle(spark: SparkSession, tables: Mapping[str, DataFrame], settings: Mapping[str, str]) -> str:
    """A canonical JSON text of the digests of tables and the settings, with its own hash."""
    import hashlib

    digests = {}
    for name, df in sorted(tables.items()):
        row = table_digest(df, name).first()
        digests[name] = {"rows": row["n_rows"], "digest": row["digest"]}
    body = {"settings": dict(sorted(settings.items())), "tables": digests}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return json.dumps(body | {"hash": hashlib.sha256(text.encode()).hexdigest()}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
