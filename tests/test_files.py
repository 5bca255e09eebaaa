import zipfile

from pyspark.sql import functions as F

from quantora.operators import formulas, grid
from quantora.sinks import tables as sinks
from quantora.sources import files


def _docx(path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "<w:p><w:r><w:t>Clause one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("0101", "wall", "m2", 12.5, "=D2*E2"), ("0102", None, "t", None, "1,234.50")], "code string, name string, unit string, quantity double, amount string")
    sinks.export_workbook({"bill": df, "empty": df.limit(0)}, str(tmp_path / "b.xlsx"))
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04 no zip")
    (tmp_path / "c.csv").write_text("﻿a,b\n1,,x\n", encoding="utf-8")
    (tmp_path / "n.txt").write_text("one\n\n two ")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4")
    _docx(tmp_path / "d.docx")
    cells = files.read_cells(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", "([^/]+)$", 1))
    got = {(r.file, r.sheet_name, r.row, r.col): (r.value, r.formula, r.number_as_text) for r in cells.collect()}
    assert got["b.xlsx", "bill", 2, 1] == ("0101", None, True)
    assert got["b.xlsx", "bill", 2, 4] == ("12.5", None, False)
    assert got["b.xlsx", "bill", 2, 5] == (None, "=D2*E2", False)
    assert ("b.xlsx", "bill", 3, 2) not in got and ("b.xlsx", "bill", 3, 4) not in got  # missing stays missing
    assert got["c.csv", "csv", 2, 3] == ("x", None, False) and ("c.csv", "csv", 2, 2) not in got
    assert not any(k[0] == "broken.xlsx" for k in got)
    states = {r.state for r in files.formula_states(cells).filter("formula is not null").collect()}
    assert states == {"missing"}
    sheets = files.read_sheets(spark, str(tmp_path / "b.xlsx"))
    assert [(r.sheet_name, r.n_rows, r.n_cols, r.state) for r in sheets.orderBy("sheet_index").collect()] == [("bill", 3, 5, "visible"), ("empty", 1, 5, "visible")]
    seen = files.census(files.read_cells(spark, str(tmp_path / "b.xlsx")), sheets)
    assert {r.state for r in seen.collect()} == {"same"}
    assert files.compare_readers(sheets.select("file", "sheet_index", "n_rows"), sheets.select("file", "sheet_index", (F.col("n_rows") + 1).alias("n_rows")), ["file", "sheet_index"]).count() == 2
    texts = {(r.file.rsplit("/", 1)[-1], r["index"]): r.text for r in files.read_paragraphs(spark, str(tmp_path)).collect()}
    assert texts == {("d.docx", 1): "Clause one", ("d.docx", 2): "a | b", ("n.txt", 1): "one", ("n.txt", 3): "two"}
    kinds = {r.path.rsplit("/", 1)[-1]: r.status for r in files.intake(spark, str(tmp_path)).collect()}
    assert kinds["p.pdf"] == "unsupported" and kinds["b.xlsx"] == "ok"


def test_header_and_rows(spark, tmp_path):
    rows = [("title", None, None, None, None), ("清单编码", "清单名称", "计量单位", "工程量", "合价"), ("01", "wall", "m2", "1", "10"), (None, "小计", None, None, "10"), (None, None, None, "3", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    sinks.export_workbook({"s": df}, str(tmp_path / "w.xlsx"))
    cells = files.effective_grid(files.read_cells(spark, str(tmp_path)))
    h = grid.detect_headers(cells).collect()
    assert len(h) == 1 and h[0].header_row == 3 and h[0].col_map["amount"] == 5 and not h[0].needs_review
    kinds = {r.row: r["class"] for r in grid.extract_rows(cells).collect()}
    assert kinds == {4: "detail", 5: "subtotal", 6: "trailing"}


def test_manifest_and_duplicates(spark):
    got = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2")], "path string, sha256 string")
    entries = spark.createDataFrame([("e1", "s2", None), ("e2", "s1", None), ("e3", "s9", "c"), ("e4", "s8", "z"), ("e5", None, None)], "entry string, sha256 string, path string")
    states = {r.entry: r.state for r in files.assess_manifest(entries, got).collect()}
    assert states == {"e1": "present", "e2": "ambiguous", "e3": "mismatch", "e4": "missing", "e5": "unbound"}
    assert {(r.path, r.n_copies) for r in files.distinct_files(got).collect()} == {("a", 2), ("c", 1)}


def test_registered_and_upsert(spark, tmp_path):
    base = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "p int, v string")
    first = sinks.write_registered(df, base, "totals", "sig")
    second = sinks.write_registered(df, base, "totals", "sig")
    rows = {r.path: r.current for r in sinks.registered(spark, base).collect()}
    assert rows == {first: False, second: True}
    path = str(tmp_path / "up")
    sinks.upsert_partitions(df, path, "p")
    sinks.upsert_partitions(spark.createDataFrame([(2, "z")], "p int, v string"), path, "p")
    assert {(r.p, r.v) for r in spark.read.parquet(path).collect()} == {(1, "x"), (2, "z")}
    a = sinks.acceptance_bundle(spark, {"t": df}, {"k": "v"})
    assert a == sinks.acceptance_bundle(spark, {"t": df.orderBy(F.desc("p"))}, {"k": "v"})


def test_formula_references():
    cells, status = formulas.references("=SUM(A1:B2)+'Sheet 2'!$C$3*D4", "s")
    assert status == "ok" and ("Sheet 2", 3, 3) in cells and ("s", 2, 2) in cells and len(cells) == 6
    assert formulas.references("=INDIRECT(A1)", "s") == ([], "opaque")
    assert formulas.references("text", "s") == ([], "not a formula")
    assert formulas.references("=A1:ZZ99999", "s")[1] == "incomplete"


def test_formula_impact(spark):
    f = spark.createDataFrame([("s", 2, 1, "=A1+1"), ("s", 3, 1, "=A2*2"), ("s", 1, 1, "=A3")], "sheet string, row int, col int, formula string")
    e = formulas.formula_edges(f).select(F.concat_ws("!", "source_sheet", "source_row", "source_col").alias("source"), F.concat_ws("!", "sheet", "row", "col").alias("target"))
    reached = {r.node: r.depth for r in formulas.impact(e, spark.createDataFrame([("s!1!1",)], "node string")).collect()}
    assert reached == {"s!1!1": 0, "s!2!1": 1, "s!3!1": 2}


def test_formula_impact_of_long_chains(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(36)], "source string, target string")
    assert formulas.impact(e, spark.createDataFrame([("n0",)], "node string")).count() == 37


def test_every_file_has_a_status(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("x,1\n")
    (tmp_path / "e.csv").write_text("\n")
    (tmp_path / "b.xlsx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.csv").write_text("y" * 200)
    monkeypatch.setattr(files, "MOST_BYTES", 100)
    got = {r.file.rsplit("/", 1)[1]: (r.status, r.n_records) for r in files.parse_report(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("ok", 2), "e.csv": ("empty", 0), "b.xlsx": ("broken", 0), "c.pdf": ("unsupported", 0), "d.csv": ("too large", 0)}
    assert {r.file.rsplit("/", 1)[1] for r in files.read_cells(spark, str(tmp_path)).collect()} == {"a.csv"}
