"""Queries along ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantora.functions.numbers import TOTAL
from quantora.operators import sequences as seq
from quantora.plans.domain import EFFECTIVE, KEY, as_double, boq, boq_and, dbl, effective, item_key, over_boq
from quantora.sources.tables import table


def _prices(spark: SparkSession, d: str) -> DataFrame:
    """One paid price per item, direction and period: the one of the first row id."""
    rows = boq(spark, d).withColumn("item_key", item_key()).filter(F.col("amount").isNotNull() & (F.col("quantity") > 0))
    paid = F.try_divide(F.col("amount").cast("double"), F.col("quantity").cast("double"))
    return rows.groupBy("item_key", "direction", "period_no").agg(F.min_by(paid, "rid").alias("price"))


def price_vs_first(spark: SparkSession, d: str) -> DataFrame:
    """The first period of each item whose price differs from its first price, and how much."""
    rows = seq.against_first(_prices(spark, d), ["item_key", "direction"], "period_no", "price").filter(F.abs("change") > 1e-9)
    first = rows.groupBy("item_key", "direction").agg(F.min(F.struct("period_no", "price", "first_price", "change")).alias("r"))
    return first.select("item_key", "direction", "r.period_no", "r.price", "r.first_price", F.when(F.abs(F.col("r.change")) > 0.2, "high").otherwise("low").alias("severity"))


def qty_lag_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Periods in which an item's quantity at least doubled or halved against the period before."""
    rows = boq(spark, d).withColumn("item_key", item_key()).groupBy("item_key", "direction", "period_no").agg(F.sum(F.col("quantity").cast(TOTAL)).alias("quantity"))
    moved = seq.against_previous(rows, ["item_key", "direction"], "period_no", "quantity").filter((F.col("ratio") >= 2) | (F.col("ratio") <= 0.5))
    return moved.select("item_key", "direction", "period_no", as_double(F.col("quantity")).alias("quantity"), as_double(F.col("previous_quantity")).alias("previous_quantity"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines in sheet order with their flags and amounts."""
    from quantora.functions.numbers import to_decimal

    return table(spark, d, "line_items").select(
        "id", "period_id", "sheet_id", F.get_json_object("flags_json", "$.row").cast("int").alias("row"),
        F.coalesce(F.get_json_object("flags_json", "$.subtotal") == "true", F.lit(False)).alias("is_subtotal"),
        to_decimal(F.col("amount"), "decimal(24,6)").alias("amount"), "name",
    )


def segment_subtotals(spark: SparkSession, d: str) -> DataFrame:
    """Each sheet's subtotal rows against the detail rows since the subtotal before: mismatch, missing data or equal."""
    rows = _lines(spark, d).filter("sheet_id is not null and row is not null").withColumn("_o", F.struct("row", "id"))
    marked = seq.segments(rows, ["sheet_id"], "_o", F.col("is_subtotal"))
    sums = marked.groupBy("sheet_id", "segment").agg(
        F.sum(F.when(~F.col("is_subtotal"), F.col("amount"))).alias("details"),
        F.count_if(~F.col("is_subtotal") & F.col("amount").isNull()).alias("n_missing"),
        F.max(F.when(F.col("is_subtotal"), F.col("amount"))).alias("stated"),
        F.count_if(F.col("is_subtotal")).alias("_n"),
    )
    status = F.when(F.col("n_missing") > 0, "missing data").when(F.abs(F.col("stated") - F.col("details")) <= 0.02, "equal").when(F.col("stated").isNull() | F.col("details").isNull(), "not available").otherwise("mismatch")
    return sums.filter("_n > 0").select("sheet_id", F.col("segment").cast("bigint").alias("segment"), as_double(F.col("details")).alias("details"), as_double(F.col("stated")).alias("stated"), "n_missing", status.alias("status"))


def occurrence_number(spark: SparkSession, d: str) -> DataFrame:
    """The number of each row among the rows of its item and period."""
    rows = boq(spark, d).withColumn("item_key", item_key())
    w = Window.partitionBy("direction", "period_no", "item_key").orderBy("rid")
    return rows.select("rid", F.row_number().over(w).alias("occurrence"))


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of each project."""
    rows = seq.latest(table(spark, d, "project_versions"), ["project_id"], "version_no", "id")
    return rows.select("project_id", "id", "version_no", "version_kind")


def diff_with_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Period amounts of each item with the difference to the comparable period before; gaps in the data clear the base."""
    rows = boq(spark, d).withColumn("item_key", item_key()).groupBy("direction", "item_key", "period_no").agg(
        F.sum(effective()).alias("amount"), F.count_if(effective().isNull()).alias("_gaps"), F.count_distinct("unit").alias("_units")
    )
    out = seq.with_breaks(rows, ["direction", "item_key"], "period_no", "amount", (F.col("_gaps") > 0) | (F.col("_units") > 1))
    return out.select("direction", "item_key", "period_no", as_double(F.col("amount")).alias("amount"), as_double(F.col("previous")).alias("previous"), as_double(F.col("difference")).alias("difference"))


def adjacent_periods(spark: SparkSession, d: str) -> DataFrame:
    """Each settlement period with the one before it in its project and direction."""
    w = Window.partitionBy("project_id", "direction").orderBy("period_no", "id")
    rows = table(spark, d, "settlement_periods").select("project_id", "direction", "period_no", "id", F.lag("id").over(w).alias("previous_id"))
    return rows.filter("previous_id is not null").select("id", "previous_id")


def trailing_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Rows without code at the very end of each sheet."""
    lines = table(spark, d, "line_items").select("id", "sheet_id", F.get_json_object("flags_json", "$.row").cast("int").alias("row"), F.coalesce(F.trim("code"), F.lit("")).alias("code")).filter("sheet_id is not null and row is not null")
    marked = seq.trailing_run(lines, ["sheet_id"], "row", F.col("code") == "")
    return marked.filter("trailing").select("id", "sheet_id", "row")


def section_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Each line with the chapter (first four digits) last named above it in its sheet."""
    lines = table(spark, d, "line_items").select("id", "sheet_id", F.get_json_object("flags_json", "$.row").cast("int").alias("row"), "code").filter("sheet_id is not null and row is not null")
    filled = seq.section_fill(lines.withColumn("_o", F.struct("row", "id")), ["sheet_id"], "_o", F.nullif(F.regexp_extract("code", "^([0-9]{4})", 1), F.lit("")))
    return filled.select("id", "section")


def next_period_no(spark: SparkSession, d: str) -> DataFrame:
    """The next free period number of each project and direction."""
    return table(spark, d, "settlement_periods").groupBy("project_id", "direction").agg((F.max("period_no") + 1).alias("next_no"))


def latest_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each item's latest period only, as cumulative statements are read."""
    rows = boq(spark, d).withColumn("item_key", item_key())
    last = rows.groupBy("direction", "item_key").agg(F.max("period_no").alias("period_no"))
    kept = rows.join(last, ["direction", "item_key", "period_no"])
    return kept.groupBy("direction", "item_key", "period_no").agg(F.count("*").alias("n"), as_double(F.sum(F.col("quantity").cast(TOTAL))).alias("quantity"))


def active_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions that no later version of the project with the same kind replaces."""
    v = table(spark, d, "project_versions").select("id", "project_id", "version_kind", "version_no")
    w = Window.partitionBy("project_id", "version_kind").orderBy("version_no", "id")
    replaced = v.select(F.lag("id").over(w).alias("id")).filter("id is not null")
    return v.join(replaced, "id", "left_anti")


def name_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose name differs from the first name of their code."""
    rows = boq(spark, d).filter("code <> ''").withColumn("_o", F.struct("period_no", "rid"))
    first = rows.groupBy("direction", "code").agg(F.min_by("name", "_o").alias("first_name"))
    return rows.join(first, ["direction", "code"]).filter("name <> first_name").select("rid", "name", "first_name")


def repeat_history(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the number of earlier findings of the same project, rule and message."""
    w = Window.partitionBy("project_id", "rule_id", "message").orderBy("created_at", "id")
    rows = table(spark, d, "anomalies").select("id", (F.row_number().over(w) - 1).alias("n_before"), F.lag("id").over(w).alias("previous_id"))
    return rows.filter("n_before > 0")


_PRICES = f"p AS (SELECT {KEY} AS item_key, direction, period_no, arg_min(CAST(amount AS DOUBLE) / CAST(quantity AS DOUBLE), rid) AS price FROM boq WHERE amount IS NOT NULL AND quantity > 0 GROUP BY ALL)"
_ROW = "CAST(json_extract_string(flags_json, '$.row') AS INTEGER)"
_AMOUNT = "TRY_CAST(regexp_replace(regexp_replace(translate(amount, '０１２３４５６７８９．，（）－', '0123456789.,()-'), '[,\\s¥￥元\\x{00A0}]', '', 'g'), '^\\((.*)\\)$', '-\\1') AS DECIMAL(24,6))"

ORACLES = {
    "price_vs_first": boq_and(
        _PRICES + ", f AS (SELECT *, first_value(price) OVER (PARTITION BY item_key, direction ORDER BY period_no) AS first_price FROM p)",
        """SELECT item_key, direction, arg_min(period_no, period_no) AS period_no, arg_min(price, period_no) AS price, arg_min(first_price, period_no) AS first_price,
        CASE WHEN abs(arg_min((price - first_price) / first_price, period_no)) > 0.2 THEN 'high' ELSE 'low' END AS severity FROM f WHERE abs((price - first_price) / first_price) > 1e-9 GROUP BY ALL""",
    ),
    "qty_lag_ratio": boq_and(
        f"q AS (SELECT {KEY} AS item_key, direction, period_no, sum(quantity) AS quantity FROM boq GROUP BY ALL), l AS (SELECT *, lag(quantity) OVER (PARTITION BY item_key, direction ORDER BY period_no) AS prev FROM q WHERE quantity IS NOT NULL)",
        f"SELECT item_key, direction, period_no, {dbl('quantity')} AS quantity, {dbl('prev')} AS previous_quantity FROM l WHERE prev <> 0 AND (CAST(quantity AS DOUBLE) / CAST(prev AS DOUBLE) >= 2 OR CAST(quantity AS DOUBLE) / CAST(prev AS DOUBLE) <= 0.5)",
    ),
    "segment_subtotals": f"""
        WITH r AS (SELECT id, sheet_id, {_ROW} AS row, coalesce(json_extract_string(flags_json, '$.subtotal') = 'true', false) AS sub, {_AMOUNT} AS amount FROM line_items WHERE sheet_id IS NOT NULL),
        s AS (SELECT *, coalesce(sum(CAST(sub AS INT)) OVER (PARTITION BY sheet_id ORDER BY row, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM r WHERE row IS NOT NULL),
        g AS (SELECT sheet_id, CAST(segment AS BIGINT) AS segment, sum(amount) FILTER (WHERE NOT sub) AS details, max(amount) FILTER (WHERE sub) AS stated, count(*) FILTER (WHERE NOT sub AND amount IS NULL) AS n_missing, count(*) FILTER (WHERE sub) AS n FROM s GROUP BY ALL)
        SELECT sheet_id, segment, {dbl('details')} AS details, {dbl('stated')} AS stated, n_missing,
          CASE WHEN n_missing > 0 THEN 'missing data' WHEN abs(stated - details) <= 0.02 THEN 'equal' WHEN stated IS NULL OR details IS NULL THEN 'not available' ELSE 'mismatch' END AS status FROM g WHERE n > 0""",
    "occurrence_number": over_boq(f"SELECT rid, CAST(row_number() OVER (PARTITION BY direction, period_no, {KEY} ORDER BY rid) AS INTEGER) AS occurrence FROM boq"),
    "latest_version": "SELECT project_id, id, version_no, version_kind FROM project_versions QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY version_no DESC, id DESC) = 1",
    "diff_with_breaks": boq_and(
        f"""g AS (SELECT direction, {KEY} AS item_key, period_no, sum({EFFECTIVE}) AS amount, count(*) FILTER (WHERE {EFFECTIVE} IS NULL) > 0 OR count(DISTINCT unit) > 1 AS brk FROM boq GROUP BY ALL),
        i AS (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY direction, item_key ORDER BY period_no) AS island FROM g),
        l AS (SELECT *, CASE WHEN NOT brk THEN lag(amount) OVER (PARTITION BY direction, item_key, island, brk ORDER BY period_no) END AS prev FROM i)""",
        f"SELECT direction, item_key, period_no, {dbl('amount')} AS amount, {dbl('prev')} AS previous, {dbl('amount - prev')} AS difference FROM l",
    ),
    "adjacent_periods": "SELECT id, previous_id FROM (SELECT id, lag(id) OVER (PARTITION BY project_id, direction ORDER BY period_no, id) AS previous_id FROM settlement_periods) WHERE previous_id IS NOT NULL",
    "trailing_orphans": f"""WITH r AS (SELECT id, sheet_id, {_ROW} AS row, coalesce(trim(code), '') = '' AS o FROM line_items WHERE sheet_id IS NOT NULL), m AS (SELECT sheet_id, max(row) FILTER (WHERE NOT o) AS kept FROM r WHERE row IS NOT NULL GROUP BY ALL)
        SELECT id, sheet_id, row FROM r JOIN m USING (sheet_id) WHERE o AND row IS NOT NULL AND (kept IS NULL OR row > kept)""",
    "section_numbers": f"""SELECT id, last_value(nullif(regexp_extract(code, '^([0-9]{{4}})', 1), '') IGNORE NULLS) OVER (PARTITION BY sheet_id ORDER BY {_ROW}, id) AS section
        FROM line_items WHERE sheet_id IS NOT NULL AND {_ROW} IS NOT NULL""",
    "next_period_no": "SELECT project_id, direction, CAST(max(period_no) + 1 AS INTEGER) AS next_no FROM settlement_periods GROUP BY ALL",
    "latest_cumulative": over_boq(
        f"SELECT direction, item_key, period_no, count(*) AS n, {dbl('sum(quantity)')} AS quantity FROM (SELECT *, {KEY} AS item_key, max(period_no) OVER (PARTITION BY direction, {KEY}) AS last FROM boq) WHERE period_no = last GROUP BY ALL"
    ),
    "active_versions": "SELECT id, project_id, version_kind, version_no FROM project_versions QUALIFY row_number() OVER (PARTITION BY project_id, version_kind ORDER BY version_no DESC, id DESC) = 1",
    "name_changes": over_boq("SELECT rid, name, first_name FROM (SELECT rid, name, first_value(name) OVER (PARTITION BY direction, code ORDER BY period_no, rid) AS first_name FROM boq WHERE code <> '') WHERE name <> first_name"),
    "repeat_history": "SELECT id, CAST(n - 1 AS INTEGER) AS n_before, previous_id FROM (SELECT id, row_number() OVER w AS n, lag(id) OVER w AS previous_id FROM anomalies WINDOW w AS (PARTITION BY project_id, rule_id, message ORDER BY created_at, id)) WHERE n > 1",
}
QUERIES = {name: globals()[name] for name in ORACLES}
