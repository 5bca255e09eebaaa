"""Three independent totals of a settlement compared: items, raw grid, stated control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantora.functions.numbers import TOTAL, to_decimal
from quantora.operators import grid
from quantora.session import cut_lineage

TOLERANCE = "0.02"


def path_items(items: DataFrame, key: str) -> DataFrame:
    """A: total of the detail items, and how many have no amount."""
    return items.groupBy(key).agg(F.sum(F.col("amount").cast(TOTAL)).alias("a_total"), F.count("*").alias("a_rows"), F.count_if(F.col("amount").isNull()).alias("a_missing"))


def path_grid(cells: DataFrame, key: str = "sheet_id") -> DataFrame:
    """B: the same total read again from the raw cells, with its own classification of rows."""
    return _detail_totals(grid.extract_rows(cells), key)


def _detail_totals(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter("class = 'detail'").groupBy(key).agg(F.sum(to_decimal(F.col("amount"), "decimal(24,6)").cast(TOTAL)).alias("b_total"), F.count("*").alias("b_rows"))


def path_control(cells: DataFrame, key: str = "sheet_id") -> DataFrame:
    """C: the one grand total of the sheet, else the sum of its subtotals, else unavailable; never a guess."""
    return _stated_totals(grid.extract_rows(cells), key)


def _stated_totals(rows: DataFrame, key: str) -> DataFrame:
    rows = rows.filter(F.col("class").isin("grand_total", "subtotal")).withColumn("_v", to_decimal(F.col("amount"), "decimal(24,6)").cast(TOTAL))
    grand, sub = F.col("class") == "grand_total", F.col("class") == "subtotal"
    g = rows.groupBy(key).agg(
        F.count_if(grand).alias("c_grand"), F.max(F.when(grand, F.col("_v"))).alias("_gt"), F.count_if(grand & F.col("_v").isNull()).alias("_no"),
        F.sum(F.when(sub, F.col("_v"))).alias("_st"), F.count_if(sub & F.col("_v").isNull()).alias("c_unread"), F.count_if(sub).alias("c_sub"),
    )
    value = F.when(F.col("c_grand") == 1, F.col("_gt")).when((F.col("c_grand") == 0) & (F.col("c_sub") > 0) & (F.col("c_unread") == 0), F.col("_st"))
    return g.select(key, value.alias("c_total"), "c_grand", (F.col("c_unread") + F.col("_no")).alias("c_unread"))


#: Why a check is insufficient, in the order in which it is said.
REASONS = ("incomplete", "missing amounts", "unreadable amounts", "rows without a class", "no control", "several grand totals", "unreadable totals")


def cross_check(items: DataFrame, cells: DataFrame, key: str = "sheet_id") -> DataFrame:
    """a, b and c totals per sheet, the status of a against b and of a against c, the reasons and level of assurance, and all in one.

    ``combined``, by precedence: incomplete, diff (either comparison), unverified (no
    control), match.
    """
    rows = cut_lineage(grid.extract_rows(cells).select(key, "class", "amount"))
    doubtful = rows.groupBy(key).agg(
        F.count_if((F.col("class") == "detail") & F.col("amount").isNotNull() & to_decimal(F.col("amount"), "decimal(24,6)").isNull()).alias("b_unread"),
        F.count_if(F.col("class").isin("orphan", "trailing")).alias("b_orphans"),
    )
    joined = path_items(items, key).join(_detail_totals(rows, key), key, "full").join(_stated_totals(rows, key), key, "left").join(doubtful, key, "left")
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= F.lit(TOLERANCE).cast("decimal(4,2)")
    ab = F.when(F.col("a_total").isNull() | F.col("b_total").isNull(), "incomplete").when(near("a_total", "b_total") & (F.col("a_rows") == F.col("b_rows")), "match").otherwise("diff")
    c = F.when(F.col("c_total").isNull(), "not_available").when(near("a_total", "c_total"), "match").otherwise("diff")
    tests = (ab == "incomplete", F.col("a_missing") > 0, F.col("b_unread") > 0, F.col("b_orphans") > 0, F.col("c_total").isNull(), F.col("c_grand") > 1, F.col("c_unread") > 0)
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(why)) for why, test in zip(REASONS, tests, strict=True)]))
    out = joined.withColumn("ab_status", ab).withColumn("control_status", c).withColumn("reasons", reasons)
    differs = (F.col("ab_status") == "diff") | (F.col("control_status") == "diff")
    level = F.when(F.size("reasons") > 0, "insufficient").when(differs, "findings").otherwise("sufficient")
    combined = F.when(F.col("ab_status") == "incomplete", "incomplete").when(differs, "diff").when(F.col("control_status") == "not_available", "unverified").otherwise("match")
    return out.withColumn("level", level).withColumn("combined", combined)


def control_candidates(cells: DataFrame, key: str = "sheet_id") -> DataFrame:
    """The rows of totals by class against those found again in the raw cells by their words alone, per sheet, and whether the sets agree."""
    classed = grid.extract_rows(cells).filter(F.col("class").isin("grand_total", "subtotal")).groupBy(key).agg(F.sort_array(F.collect_set("row")).alias("by_class"))
    said = cells.filter(grid.is_grand_total(F.col("value")) | grid.is_subtotal(F.col("value"))).select(key, "row").distinct()
    header = grid.detect_headers(cells).select(key, "header_last")
    again = said.join(header, key).filter("row > header_last").groupBy(key).agg(F.sort_array(F.collect_set("row")).alias("by_words"))
    none = F.array().cast("array<int>")
    both = header.join(classed, key, "left").join(again, key, "left")
    return both.select(key, F.coalesce("by_class", none).alias("by_class"), F.coalesce("by_words", none).alias("by_words")).withColumn("agree", F.col("by_class") == F.col("by_words"))
