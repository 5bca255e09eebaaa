"""Facts of worksheets and of amount cells, derived from the sheet and line tables for both engines.

The settlement tables hold no layout, so hidden rows, merged ranges, filters, columns
and formulas are made from the ids: the same rule in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.functions.numbers import decimal_text, to_decimal
from quantora.sources.tables import table

KEY_COLUMNS = ("code", "name", "unit", "quantity", "unit_price", "amount")


def sheet_facts(spark: SparkSession, d: str) -> DataFrame:
    """sheet_id, sheet_name, hidden_rows, hidden_cols, merged (first rows), header_last, columns, filter_state, confidence."""
    i = F.col("id")
    some = lambda test, array: F.when(test, array).otherwise(F.array().cast("array<int>"))
    gone = F.when(i % 17 == 0, F.array(F.lit("unit_price"), F.lit("amount"))).when(i % 19 == 0, F.array(F.lit("code"))).when(i % 23 == 0, F.array(F.lit("quantity"), F.lit("unit_price"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "raw_sheets").select(
        i.alias("sheet_id"),
        "sheet_name",
        some(i % 7 == 0, F.sequence(F.lit(1), (i % 3 + 1).cast("int"))).alias("hidden_rows"),
        some(i % 11 == 0, F.array(F.lit(2))).alias("hidden_cols"),
        some(i % 5 == 0, F.array(F.lit(1), (i % 9 + 1).cast("int"))).alias("merged"),
        F.lit(3).alias("header_last"),
        F.array_except(F.array(*[F.lit(c) for c in KEY_COLUMNS]), gone).alias("columns"),
        F.when(i % 13 == 0, "unknown").when(i % 13 == 1, "filtered").otherwise("none").alias("filter_state"),
        ((i % 10) / F.lit(10.0)).alias("confidence"),
    )


def amount_cells(spark: SparkSession, d: str) -> DataFrame:
    """line_id, sheet_id, row, is_control, formula, error, cached, trusted: the amount cell of each line that has a row."""
    i, row = F.col("id"), F.get_json_object("flags_json", "$.row").cast("int")
    r = row.cast("string")
    formula = (
        F.when(i % 6 == 0, F.concat(F.lit("=E"), r, F.lit("*F"), r))
        .when(i % 6 == 1, F.concat(F.lit("=E"), r, F.lit("*F"), (row + 1).cast("string")))
        .when(i % 6 == 3, F.concat(F.lit("=F"), r, F.lit("*E"), r))
        .when(i % 6 == 4, F.lit("=SUM(G4:G9)"))
        .when(i % 6 == 5, F.concat(F.lit("=E"), r, F.lit("+F"), r))
    )
    return table(spark, d, "line_items").select(
        i.alias("line_id"), "sheet_id", row.alias("row"), F.coalesce(F.get_json_object("flags_json", "$.subtotal") == "true", F.lit(False)).alias("is_control"), formula.alias("formula"),
        F.when(i % 29 == 0, "#DIV/0!").alias("error"), (i % 9 != 0).alias("cached"), (i % 23 != 0).alias("trusted"),
    ).filter("row is not null")


def typed_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines with exact figures, what the figures were typed as, and their flags."""
    flag = lambda k: F.coalesce(F.get_json_object("flags_json", f"$.{k}") == "true", F.lit(False))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    figures = ("quantity", "unit_price", "amount")
    return table(spark, d, "line_items").select(
        F.col("id").alias("line_id"), "period_id", "sheet_id", F.get_json_object("flags_json", "$.row").cast("int").alias("row"), flag("subtotal").alias("is_subtotal"), flag("deduction").alias("is_deduction"),
        text("code").alias("code"), text("name").alias("name"), *[text(c).alias(f"{c}_text") for c in figures], *[to_decimal(F.col(c), "decimal(24,6)").alias(c) for c in figures],
        *[decimal_text(F.col(c)).isNotNull().alias(f"{c}_read") for c in figures],
    )


_ROW = "CAST(json_extract_string(flags_json, '$.row') AS INTEGER)"
SHEET_FACTS = """SELECT id AS sheet_id, sheet_name, CASE WHEN id % 7 = 0 THEN range(1, id % 3 + 2) ELSE [] END AS hidden_rows, CASE WHEN id % 11 = 0 THEN [2] ELSE [] END AS hidden_cols, CASE WHEN id % 5 = 0 THEN [1, id % 9 + 1] ELSE [] END AS merged,
  3 AS header_last, list_filter(['code', 'name', 'unit', 'quantity', 'unit_price', 'amount'], lambda c: NOT (id % 17 = 0 AND c IN ('unit_price', 'amount')) AND NOT (id % 17 <> 0 AND id % 19 = 0 AND c = 'code') AND NOT (id % 17 <> 0 AND id % 19 <> 0 AND id % 23 = 0 AND c IN ('quantity', 'unit_price'))) AS columns,
  CASE WHEN id % 13 = 0 THEN 'unknown' WHEN id % 13 = 1 THEN 'filtered' ELSE 'none' END AS filter_state, (id % 10) / 10.0 AS confidence FROM raw_sheets"""
AMOUNT_CELLS = f"""SELECT * FROM (SELECT id AS line_id, sheet_id, {_ROW} AS row, coalesce(json_extract_string(flags_json, '$.subtotal') = 'true', false) AS is_control,
  CASE id % 6 WHEN 0 THEN '=E' || {_ROW} || '*F' || {_ROW} WHEN 1 THEN '=E' || {_ROW} || '*F' || ({_ROW} + 1) WHEN 3 THEN '=F' || {_ROW} || '*E' || {_ROW} WHEN 4 THEN '=SUM(G4:G9)' WHEN 5 THEN '=E' || {_ROW} || '+F' || {_ROW} END AS formula,
  CASE WHEN id % 29 = 0 THEN '#DIV/0!' END AS error, id % 9 <> 0 AS cached, id % 23 <> 0 AS trusted FROM line_items) WHERE row IS NOT NULL"""
