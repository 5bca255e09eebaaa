"""Operators along ordered rows: first and previous values, segments, islands, trailing runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def against_first(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Add first_<value> (of the earliest row with a value) and the change against it as a ratio."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(value, ignorenulls=True).over(w)
    out = rows.withColumn(f"first_{value}", first)
    return out.withColumn("change", F.try_divide(F.col(value).cast("double") - F.col(f"first_{value}").cast("double"), F.col(f"first_{value}").cast("double")))


def against_previous(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Add previous_<value> (the last earlier row with a value) and the ratio to it; a zero base has none."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = rows.filter(F.col(value).isNotNull())
    out = known.withColumn(f"previous_{value}", F.lag(value).over(w))
    return out.withColumn("ratio", F.try_divide(F.col(value).cast("double"), F.nullif(F.col(f"previous_{value}").cast("double"), F.lit(0.0))))


def segments(rows: DataFrame, keys: list[str], order: str, closes: Column) -> DataFrame:
    """Add ``segment``: how many closing rows stand before a row; a closing row ends its own segment."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("segment", F.coalesce(F.sum(closes.cast("int")).over(w), F.lit(0)))


def with_breaks(rows: DataFrame, keys: list[str], order: str, value: str, breaks: Column) -> DataFrame:
    """Add previous and difference along islands: a break clears the base, the next usable row starts anew.

    A zero base gives a difference but no rate.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_break", F.coalesce(breaks, F.lit(True)))
    # The row of a break belongs to no island; rows after it start the next one.
    marked = marked.withColumn("_island", F.sum(F.col("_break").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy(*keys, "_island", "_break").orderBy(order)
    previous = F.when(~F.col("_break"), F.lag(value).over(inside))
    out = marked.withColumn("previous", previous)
    out = out.withColumn("difference", F.col(value) - F.col("previous"))
    rate = F.try_divide(F.col("difference").cast("double"), F.nullif(F.col("previous").cast("double"), F.lit(0.0)))
    return out.withColumn("rate", rate).drop("_break", "_island")


def trailing_run(rows: DataFrame, keys: list[str], order: str, orphan: Column) -> DataFrame:
    """Add ``trailing``: the row is in the run of orphan rows that ends its group."""
    all_of = Window.partitionBy(*keys)
    last_kept = F.max(F.when(~orphan, F.col(order))).over(all_of)
    return rows.withColumn("trailing", F.coalesce(F.col(order) > last_kept, F.lit(True)) & orphan)


def section_fill(rows: DataFrame, keys: list[str], order: str, event: Column) -> DataFrame:
    """Add ``section``: the last event (a text where a section opens or closes) at or before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.last(event, ignorenulls=True).over(w))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last by the given columns; by aggregation, so that no group is sorted in one task."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("_r"))
    return best.select("_r.*")
