"""Bill-of-quantities items derived from the order tables, for both engines.

``boq`` is the reference's line-item shape with exact decimals: direction, period,
code (empty for some), name, feature, unit, quantity, unit_price, amount, tax_rate and
a deduction flag. ``rid`` is a text key that is the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.functions.numbers import INPUT, PRODUCT, TOTAL
from quantora.sources.tables import table


def boq(spark: SparkSession, d: str, near: str | None = None) -> DataFrame:
    """The items; one broadcast-or-shuffle join by size, no wider columns than needed.

    What lines alone decide is computed before the join, so that a shuffle moves narrow
    columns. ``near`` is a column of the lines that is kept, and by which they are
    partitioned before they get wide.
    """
    n, odd = F.col("l_linenumber"), F.col("l_suppkey") % 2 == 1
    line = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        (F.col("l_linestatus") == "O").alias("_up"),
        ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate")).cast("int").alias("_period"),
        F.when(n == 3, F.col("l_extendedprice")).alias("_stated"),
        ((F.col("l_discount") == 0.10) & (F.col("l_tax") == 0.08)).alias("_unknown"),
        "l_tax", "l_returnflag", *([odd.alias("_odd")] if near else []),
    )
    line = line.repartition(near) if near else line
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    quantity = F.col("l_quantity").cast(INPUT)
    price = F.col("p_retailprice").cast(INPUT)
    product = (quantity * price).cast(INPUT)
    amount = (
        F.when(n == 5, F.lit(None).cast(INPUT))
        .when(n == 4, (product + F.lit("0.01").cast(INPUT)).cast(INPUT))
        .when(n == 3, F.col("_stated").cast(INPUT))
        .otherwise(product)
    )
    size = F.col("p_size") % 4
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint")).alias("rid"),
        F.when(F.col("_up"), "upward").otherwise("downward").alias("direction"),
        F.col("_period").alias("period_no"),
        F.when(n == 7, "").otherwise(F.col("l_partkey").cast("string")).alias("code"),
        F.when(n == 6, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).otherwise(F.col("p_name")).alias("name"),
        F.col("p_type").alias("feature"),
        F.when(size == 1, "m").when(size == 2, "m2").when(size == 3, "m3").when(F.col("_odd") if near else odd, "kg").otherwise("t").alias("unit"),
        F.when(F.col("_unknown"), F.lit(None)).otherwise(quantity).cast(INPUT).alias("quantity"),
        price.alias("unit_price"),
        amount.alias("amount"),
        F.col("l_tax").cast("decimal(6,4)").alias("tax_rate"),
        (F.col("l_returnflag") == "R").alias("is_deduction"),
        F.col("l_linenumber").alias("line_no"),
        *([near] if near else []),
    )


def item_key(code: str = "code", name: str = "name") -> Column:
    """``code:<c>``, or ``name:<n>`` for items without code."""
    return F.when(F.col(code) != "", F.concat(F.lit("code:"), F.col(code))).otherwise(F.concat(F.lit("name:"), F.col(name)))


def calculated() -> Column:
    """quantity x unit_price, exact; null if either is missing."""
    return (F.col("quantity") * F.col("unit_price")).cast(PRODUCT)


def effective() -> Column:
    """The stated amount, else the calculated one, else missing."""
    return F.coalesce(F.col("amount").cast(TOTAL), calculated().cast(TOTAL))


def as_double(c: Column, digits: int = 4) -> Column:
    """A decimal for comparison across engines."""
    return F.round(c, digits).cast("double")


BOQ = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS rid,
  CASE WHEN l_linestatus = 'O' THEN 'upward' ELSE 'downward' END AS direction,
  CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) AS INTEGER) AS period_no,
  CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS code,
  CASE WHEN l_linenumber = 6 THEN p_name || ' (' || p_brand || ')' ELSE p_name END AS name,
  p_type AS feature,
  CASE p_size % 4 WHEN 1 THEN 'm' WHEN 2 THEN 'm2' WHEN 3 THEN 'm3' ELSE CASE WHEN l_suppkey % 2 = 1 THEN 'kg' ELSE 't' END END AS unit,
  CASE WHEN l_discount = 0.10 AND l_tax = 0.08 THEN NULL ELSE CAST(l_quantity AS DECIMAL(18,6)) END AS quantity,
  CAST(p_retailprice AS DECIMAL(18,6)) AS unit_price,
  CASE l_linenumber WHEN 5 THEN NULL
    WHEN 4 THEN CAST(CAST(l_quantity AS DECIMAL(18,6)) * CAST(p_retailprice AS DECIMAL(18,6)) AS DECIMAL(18,6)) + 0.01
    WHEN 3 THEN CAST(l_extendedprice AS DECIMAL(18,6))
    ELSE CAST(CAST(l_quantity AS DECIMAL(18,6)) * CAST(p_retailprice AS DECIMAL(18,6)) AS DECIMAL(18,6)) END AS amount,
  CAST(l_tax AS DECIMAL(6,4)) AS tax_rate, l_returnflag = 'R' AS is_deduction, l_linenumber AS line_no
FROM lineitem JOIN part ON p_partkey = l_partkey
"""
KEY = "CASE WHEN code <> '' THEN 'code:' || code ELSE 'name:' || name END"
EFFECTIVE = "coalesce(CAST(amount AS DECIMAL(38,6)), CAST(quantity * unit_price AS DECIMAL(38,6)))"


def dbl(expression: str, digits: int = 4) -> str:
    """A DuckDB number rounded to a double, as :func:`as_double` does."""
    return f"CAST(round({expression}, {digits}) AS DOUBLE)"


def over_boq(sql: str) -> str:
    """A DuckDB query over the items."""
    return f"WITH boq AS ({BOQ}) {sql}"


def boq_and(ctes: str, sql: str) -> str:
    """A DuckDB query over the items with further common tables."""
    return f"WITH boq AS ({BOQ}), {ctes} {sql}"
