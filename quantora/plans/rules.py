"""The rule catalogue: rules over items, lines, periods, sheets and cells, run together with coverage per rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.functions.numbers import PRODUCT
from quantora.functions.units import rule_unit
from quantora.operators import rulebook
from quantora.operators import sequences as seq
from quantora.operators.aggregate import several
from quantora.operators.rulebook import Rule, finding
from quantora.plans.documents import _sql_decimal
from quantora.plans.domain import KEY, boq, boq_and, item_key
from quantora.plans.sheets import AMOUNT_CELLS, SHEET_FACTS, amount_cells, sheet_facts, typed_lines
from quantora.sources.tables import table


def _finding(rows: DataFrame, rule_id, severity, subject: str) -> DataFrame:
    return finding(rows, rule_id, severity, subject)


def amount_mismatch(items: DataFrame) -> DataFrame:
    """Stated and calculated amount differ after rounding: by more than 0.02 high, else a rounding difference."""
    off = F.abs(F.round("amount", 2) - F.round((F.col("quantity") * F.col("unit_price")).cast(PRODUCT), 2))
    rows = items.withColumn("_off", off).filter(F.col("_off") > 0)
    big = F.col("_off") > F.lit("0.02").cast("decimal(4,2)")
    return _finding(rows, F.when(big, "amount_mismatch").otherwise("rounding_difference"), F.when(big, "high").otherwise("low"), "rid")


def round_amounts(items: DataFrame) -> DataFrame:
    """Whole amounts of fifty thousand or more."""
    return _finding(items.filter((F.col("amount") >= 50000) & (F.col("amount") == F.floor("amount"))), "large_round_amount", "low", "rid")


def repeated_items(items: DataFrame) -> DataFrame:
    """A code and name more than once in a period."""
    groups = items.filter("code <> ''").groupBy("direction", "period_no", "code", F.trim("name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")
    return _finding(groups.withColumn("s", F.concat_ws("/", "direction", "period_no", "code", "name")), "duplicate_item", "medium", "s")


def one_code_names(items: DataFrame) -> DataFrame:
    """A code with several names."""
    groups = items.filter("code <> ''").groupBy("direction", "code").agg(several(F.trim("name")).alias("n")).filter("n")
    return _finding(groups.withColumn("s", F.concat_ws("/", "direction", "code")), "same_code_different_name", "medium", "s")


def one_name_codes(items: DataFrame) -> DataFrame:
    """A name with several codes."""
    groups = items.groupBy("direction", "name").agg(several(F.nullif("code", F.lit(""))).alias("n")).filter("n")
    return _finding(groups.withColumn("s", F.concat_ws("/", "direction", "name")), "same_name_different_code", "low", "s")


def unit_changes(items: DataFrame) -> DataFrame:
    """An item with several units across its periods."""
    groups = items.withColumn("k", item_key()).groupBy("direction", "k").agg(several(rule_unit(F.col("unit"))).alias("n")).filter("n")
    return _finding(groups.withColumn("s", F.concat_ws("/", "direction", "k")), "unit_changed", "high", "s")


def tax_changes(items: DataFrame) -> DataFrame:
    """An item whose first tax rate per period varies."""
    first = items.withColumn("k", item_key()).groupBy("direction", "k", "period_no").agg(F.min_by("tax_rate", "rid").alias("t"))
    groups = first.groupBy("direction", "k").agg(several(F.col("t")).alias("n")).filter("n")
    return _finding(groups.withColumn("s", F.concat_ws("/", "direction", "k")), "tax_rate_changed", "medium", "s")


def quantity_jumps(items: DataFrame) -> DataFrame:
    """Quantities that at least double or halve between periods."""
    rows = items.withColumn("k", item_key()).groupBy("direction", "k", "period_no").agg(F.sum("quantity").alias("quantity"))
    moved = seq.against_previous(rows, ["direction", "k"], "period_no", "quantity").filter((F.col("ratio") >= 2) | (F.col("ratio") <= 0.5))
    return _finding(moved.withColumn("s", F.concat_ws("/", "direction", "k", "period_no")), "quantity_jump", "medium", "s")


def double_settlement(items: DataFrame) -> DataFrame:
    """The same item, quantity, price and amount in several periods."""
    groups = items.withColumn("k", item_key()).groupBy("direction", "k", "quantity", "unit_price", "amount").agg(several(F.col("period_no")).alias("n")).filter("n")
    return _finding(groups.withColumn("s", F.concat_ws("/", "direction", "k")), "suspected_double_settlement", "medium", "s")


def missing_fields(items: DataFrame) -> DataFrame:
    """Rows that neither state an amount nor allow one to be calculated, or lack a code."""
    gaps = F.filter(F.array(F.when(F.col("code") == "", F.lit("code")), F.when(F.col("amount").isNull() & (F.col("quantity").isNull() | F.col("unit_price").isNull()), F.lit("amount"))), lambda x: x.isNotNull())
    rows = items.select("rid", F.explode(gaps).alias("gap"))
    return _finding(rows.withColumn("s", F.concat_ws("/", "rid", "gap")), "missing_field", "medium", "s")


def price_changes(items: DataFrame) -> DataFrame:
    """The first period in which an item's paid price leaves its first price: by more than a fifth high, else low."""
    paid = items.filter(F.col("amount").isNotNull() & (F.col("quantity") > 0)).withColumn("k", item_key()).groupBy("direction", "k", "period_no").agg(F.min_by(F.try_divide(F.col("amount").cast("double"), F.col("quantity").cast("double")), "rid").alias("price"))
    moved = seq.against_first(paid, ["direction", "k"], "period_no", "price").filter(F.abs("change") > 1e-9)
    first = moved.groupBy("direction", "k").agg(F.min(F.struct("period_no", "change")).alias("r"))
    big = F.abs(F.col("r.change")) > 0.2
    return finding(first, F.when(big, "price_abnormal_change").otherwise("price_changed"), F.when(big, "high").otherwise("low"), "direction", "k", F.col("r.period_no"))


def negative_quantities(lines: DataFrame) -> DataFrame:
    """Quantities below zero: high, or medium where the amount is negative too."""
    return finding(lines.filter("quantity < 0"), "negative_quantity", F.when(F.col("amount") < 0, "medium").otherwise("high"), "line_id")


def unread_figures(lines: DataFrame) -> DataFrame:
    """Texts in figure columns that are no figure, one finding each."""
    gaps = F.array_compact(F.array(*[F.when(F.col(f"{c}_text").isNotNull() & ~F.col(f"{c}_read"), F.lit(c)) for c in ("quantity", "unit_price", "amount")]))
    return finding(lines.select("line_id", F.explode(gaps).alias("field")), "unparsed_number", "high", "line_id", "field")


def orphan_figures(lines: DataFrame) -> DataFrame:
    """Figures in a row without code and name."""
    return finding(lines.filter("code is null and name is null and not is_subtotal and coalesce(quantity, unit_price, amount) is not null"), "orphan_numeric_row", "medium", "line_id")


def subtotal_differences(lines: DataFrame) -> DataFrame:
    """Subtotals against the rows since the subtotal before: rows without amount are named first, then a difference beyond 0.02."""
    rows = lines.filter("sheet_id is not null and row is not null").withColumn("_o", F.struct("row", "line_id"))
    marked = seq.segments(rows, ["sheet_id"], "_o", F.col("is_subtotal"))
    detail = ~F.col("is_subtotal")
    sums = marked.groupBy("sheet_id", "segment").agg(
        F.sum(F.when(detail, F.col("amount"))).alias("details"), F.count_if(detail & F.col("amount").isNull()).alias("gaps"), F.max(F.when(~detail, F.col("amount"))).alias("stated"), F.count_if(~detail).alias("closes")
    )
    missing = F.col("gaps") > 0
    off = F.abs(F.col("stated") - F.col("details")) > F.lit("0.02").cast("decimal(4,2)")
    return finding(sums.filter((F.col("closes") > 0) & (missing | off)), F.when(missing, "summary_missing_data").otherwise("summary_mismatch"), F.when(missing, "medium").otherwise("high"), "sheet_id", "segment")


def mixed_tax_modes(periods: DataFrame) -> DataFrame:
    """Directions of a project whose periods are billed with and without tax."""
    known = periods.filter("tax_mode is not null and tax_mode not in ('', 'unknown')")
    return finding(known.groupBy("project_id", "direction").agg(several(F.col("tax_mode")).alias("n")).filter("n"), "tax_mode_mixed", "high", "project_id", "direction")


def hidden_parts(sheets: DataFrame) -> DataFrame:
    """Sheets with hidden rows or columns."""
    parts = F.array_compact(F.array(F.when(F.size("hidden_rows") > 0, F.lit("hidden_rows")), F.when(F.size("hidden_cols") > 0, F.lit("hidden_cols"))))
    return finding(sheets.select("sheet_id", F.explode(parts).alias("what")), F.col("what"), "medium", "sheet_id")


def formula_states(cells: DataFrame) -> DataFrame:
    """Formulas in error, without a cached value, or with one that cannot be trusted; the gravest is named."""
    state = F.when(F.col("error").isNotNull(), "formula_error").when(~F.col("cached"), "formula_no_cache").when(~F.col("trusted"), "formula_untrusted_cache")
    rows = cells.filter("formula is not null").withColumn("state", state).filter("state is not null")
    return finding(rows, F.col("state"), F.when(F.col("state") == "formula_error", "high").otherwise("low"), "line_id")


def formula_meanings(cells: DataFrame, quantity: str = "E", price: str = "F", amount: str = "G") -> DataFrame:
    """Amount formulas that are not quantity times price of their own row, and totals that do not read the amount column.

    Sums of cells of the same row are allowed.
    """
    r = F.col("row").cast("string")
    body = F.regexp_replace(F.upper("formula"), "[\\s$=]", "")
    product = (body == F.concat(F.lit(quantity), r, F.lit(f"*{price}"), r)) | (body == F.concat(F.lit(price), r, F.lit(f"*{quantity}"), r))
    columns = F.regexp_replace(body, "[A-Z]+([0-9]+)", "$1")
    same_row_sum = body.rlike("^[A-Z]+[0-9]+(?:[+-][A-Z]+[0-9]+)+$") & (F.size(F.array_distinct(F.split(columns, "[+-]"))) == 1) & (F.split(columns, "[+-]")[0] == r)
    wrong = F.when(F.col("is_control"), ~body.rlike(f"(?<![A-Z]){amount}[0-9]")).otherwise(~product & ~same_row_sum)
    rows = cells.filter("formula is not null").filter(wrong)
    return finding(rows, F.when(F.col("is_control"), "formula_control_semantics_mismatch").otherwise("formula_semantics_mismatch"), "high", "line_id")


def unknown_filters(sheets: DataFrame) -> DataFrame:
    """Sheets whose filter may hide rows."""
    return finding(sheets.filter("filter_state = 'unknown'"), "filter_visibility_unknown", "high", "sheet_id")


def text_figures(lines: DataFrame) -> DataFrame:
    """Figures typed as text, one finding per sheet and field with the rows that hold them."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_text").alias("text"), F.col(f"{c}_read").alias("read")) for c in ("quantity", "unit_price", "amount")])).alias("f")
    typed = lines.filter("sheet_id is not null and row is not null").select("sheet_id", "row", each).filter("f.read").filter(~F.col("f.text").rlike("^-?[0-9]+(?:\\.[0-9]+)?$"))
    rows = typed.groupBy("sheet_id", "f.field").agg(F.array_join(F.sort_array(F.collect_set("row")), ",").alias("rows"))
    return finding(rows, "text_number_in_value_col", "medium", "sheet_id", "field", "rows")


def merged_data(sheets: DataFrame) -> DataFrame:
    """Merged cells that begin below the header."""
    return finding(sheets.filter(F.exists("merged", lambda r: r > F.col("header_last"))), "merged_cells_in_data", "medium", "sheet_id")


def missing_columns(sheets: DataFrame) -> DataFrame:
    """Sheets without a key column; an amount, or quantity and price, are both a way to a price."""
    has = lambda c: F.array_contains("columns", c)
    gaps = F.array_compact(F.array(*[F.when(~has(c), F.lit(c)) for c in ("code", "name", "unit")], F.when(~has("amount") & ~(has("quantity") & has("unit_price")), F.lit("price"))))
    return finding(sheets.select("sheet_id", F.explode(gaps).alias("gap")), "missing_key_column", "medium", "sheet_id", "gap")


def doubtful_headers(sheets: DataFrame) -> DataFrame:
    """Headers found with a confidence below 0.75."""
    return finding(sheets.filter("confidence < 0.75"), "header_needs_review", "medium", "sheet_id")


def _over(frame: str, *rules) -> list[Rule]:
    return [Rule(f.__name__, (frame,), f) for f in rules]


CATALOGUE: list[Rule] = [
    *_over("items", amount_mismatch, round_amounts, repeated_items, one_code_names, one_name_codes, unit_changes, tax_changes, quantity_jumps, double_settlement, missing_fields, price_changes),
    *_over("lines", negative_quantities, unread_figures, orphan_figures, subtotal_differences, text_figures),
    *_over("periods", mixed_tax_modes),
    *_over("sheets", hidden_parts, unknown_filters, merged_data, missing_columns, doubtful_headers),
    *_over("cells", formula_states, formula_meanings),
]


def _frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"items": boq(spark, d), "lines": typed_lines(spark, d), "periods": table(spark, d, "settlement_periods"), "sheets": sheet_facts(spark, d), "cells": amount_cells(spark, d)}


def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    """All findings of the catalogue."""
    return rulebook.run(spark, CATALOGUE, _frames(spark, d))[0].drop("rule")


def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    """Findings by rule and severity, and in total."""
    return rulebook.run(spark, CATALOGUE, _frames(spark, d))[0].rollup("rule_id", "severity").agg(F.count("*").alias("n"))


def rule_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What became of each rule, where the cells of the project are not at hand and one rule is disabled."""
    frames = {k: v for k, v in _frames(spark, d).items() if k != "cells"}
    return rulebook.run(spark, CATALOGUE, frames, frozenset({"round_amounts"}))[1]


_PARTS = f"""
 k AS (SELECT *, {KEY} AS k FROM boq),
 t AS (SELECT id AS line_id, sheet_id, CAST(json_extract_string(flags_json, '$.row') AS INTEGER) AS row, coalesce(json_extract_string(flags_json, '$.subtotal') = 'true', false) AS is_subtotal, nullif(trim(code, ' '), '') AS code, nullif(trim(name, ' '), '') AS name,
   nullif(trim(quantity, ' '), '') AS quantity_text, nullif(trim(unit_price, ' '), '') AS unit_price_text, nullif(trim(amount, ' '), '') AS amount_text, {_sql_decimal('quantity')} AS quantity, {_sql_decimal('unit_price')} AS unit_price, {_sql_decimal('amount')} AS amount FROM line_items),
 sh AS ({SHEET_FACTS}), ce AS ({AMOUNT_CELLS}),
 f AS (
  SELECT CASE WHEN off > 0.02 THEN 'amount_mismatch' ELSE 'rounding_difference' END AS rule_id, CASE WHEN off > 0.02 THEN 'high' ELSE 'low' END AS severity, rid AS subject
    FROM (SELECT rid, abs(round(amount, 2) - round(quantity * unit_price, 2)) AS off FROM boq) WHERE off > 0
  UNION ALL SELECT 'large_round_amount', 'low', rid FROM boq WHERE amount >= 50000 AND amount = floor(amount)
  UNION ALL SELECT 'duplicate_item', 'medium', direction || '/' || period_no || '/' || code || '/' || trim(name) FROM boq WHERE code <> '' GROUP BY direction, period_no, code, trim(name) HAVING count(*) > 1
  UNION ALL SELECT 'same_code_different_name', 'medium', direction || '/' || code FROM boq WHERE code <> '' GROUP BY direction, code HAVING count(DISTINCT trim(name)) > 1
  UNION ALL SELECT 'same_name_different_code', 'low', direction || '/' || name FROM boq GROUP BY direction, name HAVING count(DISTINCT nullif(code, '')) > 1
  UNION ALL SELECT 'unit_changed', 'high', direction || '/' || k FROM k GROUP BY direction, k HAVING count(DISTINCT unit) > 1
  UNION ALL SELECT 'tax_rate_changed', 'medium', direction || '/' || k FROM (SELECT direction, k, period_no, arg_min(tax_rate, rid) AS t FROM k GROUP BY ALL) GROUP BY direction, k HAVING count(DISTINCT t) > 1
  UNION ALL SELECT 'quantity_jump', 'medium', direction || '/' || k || '/' || period_no FROM (SELECT *, lag(q) OVER (PARTITION BY direction, k ORDER BY period_no) AS p FROM (SELECT direction, k, period_no, sum(quantity) AS q FROM k GROUP BY ALL) WHERE q IS NOT NULL)
    WHERE p <> 0 AND (CAST(q AS DOUBLE) / CAST(p AS DOUBLE) >= 2 OR CAST(q AS DOUBLE) / CAST(p AS DOUBLE) <= 0.5)
  UNION ALL SELECT 'suspected_double_settlement', 'medium', direction || '/' || k FROM k GROUP BY direction, k, quantity, unit_price, amount HAVING count(DISTINCT period_no) > 1
  UNION ALL SELECT 'missing_field', 'medium', rid || '/code' FROM boq WHERE code = ''
  UNION ALL SELECT 'missing_field', 'medium', rid || '/amount' FROM boq WHERE amount IS NULL AND quantity IS NULL
  UNION ALL SELECT CASE WHEN abs(c) > 0.2 THEN 'price_abnormal_change' ELSE 'price_changed' END, CASE WHEN abs(c) > 0.2 THEN 'high' ELSE 'low' END, direction || '/' || k || '/' || period_no FROM
    (SELECT *, (price - first_) / nullif(first_, 0) AS c, row_number() OVER (PARTITION BY direction, k ORDER BY abs((price - first_) / nullif(first_, 0)) > 1e-9 DESC NULLS LAST, period_no) AS r FROM
      (SELECT *, first(price) OVER (PARTITION BY direction, k ORDER BY period_no) AS first_ FROM (SELECT direction, k, period_no, arg_min(CAST(amount AS DOUBLE) / CAST(quantity AS DOUBLE), rid) AS price FROM k WHERE amount IS NOT NULL AND quantity > 0 GROUP BY ALL))) WHERE r = 1 AND abs(c) > 1e-9
  UNION ALL SELECT 'negative_quantity', CASE WHEN amount < 0 THEN 'medium' ELSE 'high' END, line_id FROM t WHERE quantity < 0
  UNION ALL SELECT 'unparsed_number', 'high', line_id || '/quantity' FROM t WHERE quantity_text IS NOT NULL AND quantity IS NULL
  UNION ALL SELECT 'unparsed_number', 'high', line_id || '/unit_price' FROM t WHERE unit_price_text IS NOT NULL AND unit_price IS NULL
  UNION ALL SELECT 'unparsed_number', 'high', line_id || '/amount' FROM t WHERE amount_text IS NOT NULL AND amount IS NULL
  UNION ALL SELECT 'orphan_numeric_row', 'medium', line_id FROM t WHERE code IS NULL AND name IS NULL AND NOT is_subtotal AND coalesce(quantity, unit_price, amount) IS NOT NULL
  UNION ALL SELECT CASE WHEN gaps > 0 THEN 'summary_missing_data' ELSE 'summary_mismatch' END, CASE WHEN gaps > 0 THEN 'medium' ELSE 'high' END, sheet_id || '/' || segment FROM
    (SELECT sheet_id, segment, sum(amount) FILTER (WHERE NOT is_subtotal) AS details, count(*) FILTER (WHERE NOT is_subtotal AND amount IS NULL) AS gaps, max(amount) FILTER (WHERE is_subtotal) AS stated, count(*) FILTER (WHERE is_subtotal) AS closes FROM
      (SELECT *, coalesce(sum(CAST(is_subtotal AS INTEGER)) OVER (PARTITION BY sheet_id ORDER BY row, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM t WHERE sheet_id IS NOT NULL AND row IS NOT NULL) GROUP BY ALL)
    WHERE closes > 0 AND (gaps > 0 OR abs(stated - details) > 0.02)
  UNION ALL SELECT 'text_number_in_value_col', 'medium', sheet_id || '/' || field || '/' || string_agg(row, ',' ORDER BY row) FROM (
      SELECT DISTINCT sheet_id, 'quantity' AS field, row FROM t WHERE quantity IS NOT NULL AND NOT regexp_full_match(quantity_text, '-?[0-9]+([.][0-9]+)?')
      UNION SELECT DISTINCT sheet_id, 'unit_price', row FROM t WHERE unit_price IS NOT NULL AND NOT regexp_full_match(unit_price_text, '-?[0-9]+([.][0-9]+)?')
      UNION SELECT DISTINCT sheet_id, 'amount', row FROM t WHERE amount IS NOT NULL AND NOT regexp_full_match(amount_text, '-?[0-9]+([.][0-9]+)?')) WHERE sheet_id IS NOT NULL AND row IS NOT NULL GROUP BY sheet_id, field
  UNION ALL SELECT 'tax_mode_mixed', 'high', project_id || '/' || direction FROM settlement_periods WHERE tax_mode NOT IN ('', 'unknown') GROUP BY project_id, direction HAVING count(DISTINCT tax_mode) > 1
  UNION ALL SELECT 'hidden_rows', 'medium', CAST(sheet_id AS VARCHAR) FROM sh WHERE len(hidden_rows) > 0
  UNION ALL SELECT 'hidden_cols', 'medium', CAST(sheet_id AS VARCHAR) FROM sh WHERE len(hidden_cols) > 0
  UNION ALL SELECT 'filter_visibility_unknown', 'high', CAST(sheet_id AS VARCHAR) FROM sh WHERE filter_state = 'unknown'
  UNION ALL SELECT 'merged_cells_in_data', 'medium', CAST(sheet_id AS VARCHAR) FROM sh WHERE len(list_filter(merged, lambda r: r > header_last)) > 0
  UNION ALL SELECT 'missing_key_column', 'medium', sheet_id || '/code' FROM sh WHERE NOT list_contains(columns, 'code')
  UNION ALL SELECT 'missing_key_column', 'medium', sheet_id || '/price' FROM sh WHERE NOT list_contains(columns, 'amount') AND NOT list_contains(columns, 'unit_price')
  UNION ALL SELECT 'header_needs_review', 'medium', CAST(sheet_id AS VARCHAR) FROM sh WHERE confidence < 0.75
  UNION ALL SELECT CASE WHEN error IS NOT NULL THEN 'formula_error' WHEN NOT cached THEN 'formula_no_cache' ELSE 'formula_untrusted_cache' END, CASE WHEN error IS NOT NULL THEN 'high' ELSE 'low' END, CAST(line_id AS VARCHAR) FROM ce WHERE formula IS NOT NULL AND (error IS NOT NULL OR NOT cached OR NOT trusted)
  UNION ALL SELECT 'formula_control_semantics_mismatch', 'high', CAST(line_id AS VARCHAR) FROM ce WHERE is_control AND formula NOT LIKE '=SUM(G%'
  UNION ALL SELECT 'formula_semantics_mismatch', 'high', CAST(line_id AS VARCHAR) FROM ce WHERE NOT is_control AND (line_id % 6 = 1 OR formula LIKE '=SUM%'))
"""
ORACLES = {
    "rule_findings": boq_and(_PARTS, "SELECT * FROM f"),
    "rule_summary": boq_and(_PARTS, "SELECT rule_id, severity, count(*) AS n FROM f GROUP BY ROLLUP (rule_id, severity)"),
}
_OF = {
    "amount_mismatch": ("amount_mismatch", "rounding_difference"), "repeated_items": ("duplicate_item",), "one_code_names": ("same_code_different_name",), "one_name_codes": ("same_name_different_code",), "unit_changes": ("unit_changed",),
    "tax_changes": ("tax_rate_changed",), "quantity_jumps": ("quantity_jump",), "double_settlement": ("suspected_double_settlement",), "missing_fields": ("missing_field",), "price_changes": ("price_changed", "price_abnormal_change"),
    "negative_quantities": ("negative_quantity",), "unread_figures": ("unparsed_number",), "orphan_figures": ("orphan_numeric_row",), "subtotal_differences": ("summary_mismatch", "summary_missing_data"), "text_figures": ("text_number_in_value_col",),
    "mixed_tax_modes": ("tax_mode_mixed",), "hidden_parts": ("hidden_rows", "hidden_cols"), "unknown_filters": ("filter_visibility_unknown",), "merged_data": ("merged_cells_in_data",), "missing_columns": ("missing_key_column",), "doubtful_headers": ("header_needs_review",),
}
ORACLES["rule_coverage"] = boq_and(
    _PARTS,
    " UNION ALL ".join(f"SELECT '{r}' AS rule, 'executed' AS status, (SELECT count(*) FROM f WHERE rule_id IN ({', '.join(repr(i) for i in ids)})) AS n_findings, CAST(NULL AS VARCHAR) AS reason" for r, ids in _OF.items())
    + " UNION ALL SELECT 'round_amounts', 'skipped', NULL, 'disabled' UNION ALL SELECT 'formula_states', 'skipped', NULL, 'no cells' UNION ALL SELECT 'formula_meanings', 'skipped', NULL, 'no cells'",
)
QUERIES = {name: globals()[name] for name in ORACLES}
