"""Aggregations over items: exact sums, status lattices, unit-normalised quantities, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantora.functions.numbers import PRODUCT, TOTAL
from quantora.functions.units import MEASURES

#: Stated and calculated amounts agree within this.
TOLERANCE = "0.02"

_FACTORS = {name: (base, factor) for base, by in MEASURES.items() for factor, names in by.items() for name in names.split() if name in ("t", "kg", "g", "m", "cm", "mm", "m2", "m3")}


def unit_basis(unit: Column) -> Column:
    """struct(base, factor) of a unit; an unknown unit is its own base, an empty one is null."""
    key = F.regexp_replace(F.lower(F.trim(unit)), "[\\s^]", "")
    base, factor = key, F.lit("1").cast("decimal(18,9)")
    for name, (b, f) in _FACTORS.items():
        base = F.when(key == name, F.lit(b)).otherwise(base)
        factor = F.when(key == name, F.lit(f).cast("decimal(18,9)")).otherwise(factor)
    return F.when(F.nullif(key, F.lit("")).isNotNull(), F.struct(base.alias("base"), factor.alias("factor")))


def assess_amount(items: DataFrame) -> DataFrame:
    """Add calculated, effective, amount_source (raw, calculated, missing) and amount_check (match, diff, not_available)."""
    calc = (F.col("quantity") * F.col("unit_price")).cast(PRODUCT)
    rows = items.withColumn("calculated", calc)
    source = F.when(F.col("amount").isNotNull(), "raw").when(F.col("calculated").isNotNull(), "calculated").otherwise("missing")
    check = F.when(F.col("amount").isNull() | F.col("calculated").isNull(), "not_available").when(
        F.abs(F.col("amount") - F.col("calculated")) <= F.lit(TOLERANCE).cast("decimal(4,2)"), "match"
    ).otherwise("diff")
    return rows.withColumn("effective", F.coalesce(F.col("amount").cast(TOTAL), F.col("calculated").cast(TOTAL))).withColumn("amount_source", source).withColumn("amount_check", check)


def _amount_sums() -> dict[str, Column]:
    """Aggregates over assessed rows: counts and exact sums of stated, calculated and used amounts."""
    return {
        "n_items": F.count("*"),
        "total": F.sum("effective"),
        "raw_total": F.sum(F.col("amount").cast(TOTAL)),
        "calculated_total": F.sum(F.col("calculated").cast(TOTAL)),
        "calculated_used": F.sum(F.when(F.col("amount_source") == "calculated", F.col("calculated").cast(TOTAL))),
        "n_missing": F.count_if(F.col("amount_source") == "missing"),
        "n_derived": F.count_if(F.col("amount_source") == "calculated"),
        "n_mismatch": F.count_if(F.col("amount_check") == "diff"),
        "source": source_lattice(F.col("amount_source")),
        "check_status": check_lattice(F.col("amount_check")),
    }


def _named(sums: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in sums.items()]


def amount_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and exact sums of stated, calculated and used amounts per key; all-missing sums are null."""
    return assess_amount(items).groupBy(*keys).agg(*_named(_amount_sums()))


def source_lattice(source: Column) -> Column:
    """Aggregate: missing joined with x is x; raw joined with calculated is mixed."""
    raw, calc = F.bool_or(source == "raw"), F.bool_or(source == "calculated")
    return F.when(raw & calc, "mixed").when(raw, "raw").when(calc, "calculated").otherwise("missing")


def check_lattice(check: Column) -> Column:
    """Aggregate: diff over match over not_available."""
    return F.when(F.bool_or(check == "diff"), "diff").when(F.bool_or(check == "match"), "match").otherwise("not_available")


def several(c: Column) -> Column:
    """Aggregate: whether a column has more than one value. Smallest and largest tell, without counting distinct ones."""
    return F.coalesce(F.min(c) != F.max(c), F.lit(False))


def _with_basis(items: DataFrame) -> DataFrame:
    """The rows with their base unit, quantity in it, and feature in one spelling."""
    basis = unit_basis(F.col("unit"))
    feature = F.regexp_replace(F.lower(F.coalesce("feature", F.lit(""))), "(?U)\\s", "")
    return items.withColumn("_base", basis["base"]).withColumn("_std", (F.col("quantity") * basis["factor"]).cast(PRODUCT)).withColumn("_feature", feature)


def _quantity_sums() -> dict[str, Column]:
    return {
        "_mixed_bases": several(F.col("_base")),
        "_mixed_features": several(F.col("_feature")),
        "_no_quantity": F.count_if(F.col("_std").isNull()),
        "_sum": F.sum(F.col("_std").cast(TOTAL)),
        "_one_base": F.min("_base"),
    }


def _quantity_status() -> Column:
    return F.when(F.col("_mixed_bases") | F.col("_mixed_features"), "incomparable").when(F.col("_no_quantity") > 0, "incomplete").otherwise("ok")


def _quantity_columns() -> list[Column]:
    return [F.when(_quantity_status() == "ok", F.col("_sum")).alias("quantity"), F.when(~F.col("_mixed_bases"), F.col("_one_base")).alias("base_unit")]


def normalised_quantity(items: DataFrame, keys: list[str]) -> DataFrame:
    """quantity, base unit and status per key: incomparable beyond one measure or feature, incomplete if any is missing."""
    grouped = _with_basis(items).groupBy(*keys).agg(*_named(_quantity_sums()))
    return grouped.select(*keys, *_quantity_columns(), _quantity_status().alias("status"))


def cumulate(items: DataFrame, keys: list[str]) -> DataFrame:
    """The cumulative settlement per key: amounts, normalised quantity, weighted price and the status lattice.

    Deductions stay out. Status: incomplete if a quantity or stated amount is missing
    or a check differs; then the quantity's own status where it is worse; then
    incomparable if the quantity is zero. One aggregate over one scan of the rows.
    """
    rows = _with_basis(assess_amount(items.filter(~F.coalesce("is_deduction", F.lit(False)))))
    open_ = F.count_if(F.col("amount").isNull() | F.col("quantity").isNull()).alias("_open")
    grouped = rows.groupBy(*keys).agg(*_named(_amount_sums()), *_named(_quantity_sums()), open_)
    judged = grouped.select(*keys, *_amount_sums(), *_quantity_columns(), _quantity_status().alias("_q"), "_open")
    base = F.when((F.col("_open") > 0) | (F.col("n_mismatch") > 0), "incomplete").otherwise("ok")
    status = F.when(F.col("_q") != "ok", F.col("_q")).when((base == "ok") & (F.col("quantity") == 0), "incomparable").otherwise(base)
    price = F.try_divide(F.col("total").cast("double"), F.col("quantity").cast("double"))
    return judged.select(*keys, "n_items", "total", "raw_total", "calculated_used", "n_missing", "n_derived", "n_mismatch", "source", "check_status", "quantity", "base_unit", price.alias("average_price"), status.alias("status"))


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median per key from the (for decimals exact) sum of the middle one or two values, with min, max and count.

    Equal values are counted before anything is ordered, so a hot key costs its distinct values only.
    """
    exact = F.col(value).cast(TOTAL) if dict(rows.dtypes)[value].startswith("decimal") else F.col(value)
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(value))
    placed = counted.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    holds = lambda r: ((F.col("_upto") - F.col("_c") < r) & (F.col("_upto") >= r)).cast("int")
    middle = placed.withColumn("_m", holds(F.floor((F.col("_n") + 1) / 2)) + holds(F.floor((F.col("_n") + 2) / 2)))
    return middle.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        (F.sum(F.when(F.col("_m") > 0, exact * F.col("_m"))).cast("double") / F.lit(2)).alias("median"),
    )


#: Leading hexadecimal digits of a row's digest that name its bucket.
DIGEST_BUCKET = 3


def content_digest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One SHA-256 per key over its rows, whatever their order; repeated rows count.

    Each row is digested, row digests are sorted and digested by bucket (their leading
    digits), and bucket digests by key, so that no list holds all rows of a hot key.
    """
    canonical = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    each = rows.select(*keys, F.sha2(canonical, 256).alias("_h")).withColumn("_b", F.substring("_h", 1, DIGEST_BUCKET))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    buckets = each.groupBy(*keys, "_b").agg(F.count("*").alias("n_rows"), joined("_h").alias("_d"))
    parts = buckets.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.array_sort(F.collect_list(F.struct("_b", "_d"))).alias("_l"))
    return parts.select(*keys, "n_rows", F.sha2(F.array_join(F.transform("_l", lambda x: x["_d"]), "\n"), 256).alias("digest"))
