"""Quantities recorded in different units, converted to one base unit per kind of measure.

Only the distinct unit spellings are interpreted: an inverted index of character
bigrams proposes vocabulary entries and a weighted edit distance verifies them. The
resulting alias dictionary is joined to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantora.functions.numbers import INVISIBLE, plain_figures
from quantora.functions.units import read_unit
from quantora.session import cut_lineage, default_parallelism

# A readable figure, anything before it, and what follows it.
_FIGURE = "^[^0-9见附第#]*?((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\\.[0-9]+)?)(?![0-9]|[.,][0-9])"
_TAIL = _FIGURE + "[.,]?\\s*\\)?\\s*[\\[(【]?\\s*(.*?)\\s*[\\])】]?$"
# The ways in which a description states the unit of its quantity.
_STATEMENTS = (
    "(?i)(?:计量单位|单位|unit)\\s*[:：]\\s*([^;；,，()（）【】]+)",
    "按([^;；,，()按]{1,12}?)计量",
    "以([^;；,，()以]{1,12}?)计",
    "【([^】]{1,12})】\\s*计",
)


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), "^(?U:\\s)+|(?U:\\s)+$", ""), F.lit(""))


def quantity_parts(quantity: Column, unit: Column, feature: Column) -> list[Column]:
    """Columns ``figure`` (plain text or null), ``negative``, ``spelling`` and ``stated_in`` of a quantity.

    The unit stands in the unit field, else after the figure, else in a statement of
    the description; sizes in the description are not taken for units.
    """
    flat = plain_figures(quantity)
    figure = F.nullif(F.regexp_replace(F.regexp_extract(flat, _FIGURE, 1), ",", ""), F.lit(""))
    negative = flat.rlike("^[^0-9]*-[^0-9]*[0-9]|^[^0-9]*\\([0-9.,]+\\)(?![0-9])")
    field = _blank_to_null(unit)
    after = F.nullif(F.regexp_extract(flat, _TAIL, 2), F.lit(""))
    stated = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(plain_figures(feature), p, 1)), F.lit("")) for p in _STATEMENTS])
    spelling = F.coalesce(field, after, stated)
    where = F.when(field.isNotNull(), "unit").when(after.isNotNull(), "quantity").when(stated.isNotNull(), "feature")
    return [figure.alias("figure"), negative.alias("negative"), spelling.alias("spelling"), where.alias("stated_in")]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        read = [read_unit(s) for s in pdf["spelling"]]
        yield pd.DataFrame(
            {
                "spelling": pdf["spelling"],
                "base_unit": [r[0] for r in read],
                "factor": [r[1] for r in read],
                "method": [r[2] for r in read],
                "distance": [r[3] for r in read],
            }
        )


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """The distinct ``spelling`` values with base_unit, factor (text), method and distance.

    The values are few bytes and much work each, so they are spread over all slots
    rather than by their size.
    """
    distinct = spellings.select("spelling").filter(F.col("spelling").isNotNull()).distinct()
    return distinct.repartition(default_parallelism(spellings.sparkSession)).mapInPandas(
        _read, "spelling string, base_unit string, factor string, method string, distance double"
    )


def to_base_units(rows: DataFrame, record_id: str = "id", quantity: str = "quantity", unit: str = "unit", feature: str = "feature") -> DataFrame:
    """Every row's quantity in the base unit of its measure (t, m, m2 or m3).

    Columns: record_id, spelling, stated_in (``unit``, ``quantity``, ``feature`` or
    null), base_unit, factor (decimal), is_base (the spelling names the base unit
    itself), method, base_quantity (decimal) and status: ``converted``, ``no figure``,
    ``no unit``, ``counted`` or ``unknown unit``.

    Defined cases: nulls and blanks are no figure or no unit; a unit field wins over
    the texts; figures too wide for the decimals give a null base_quantity but stay
    ``converted``; a repeated row gives a repeated result row; other columns are not
    read; an empty table gives no rows.
    """
    parts = rows.select(F.col(record_id).alias("record_id"), *quantity_parts(F.col(quantity), F.col(unit), F.col(feature)))
    aliases = cut_lineage(alias_dictionary(parts))
    joined = parts.join(aliases, "spelling", "left")
    factor = F.col("factor").cast("decimal(20,11)")
    signed = F.when(F.col("negative"), F.concat(F.lit("-"), F.col("figure"))).otherwise(F.col("figure"))
    value = F.try_multiply(signed.try_cast("decimal(17,6)"), factor)
    status = (
        F.when(F.col("figure").isNull(), "no figure")
        .when(F.col("spelling").isNull(), "no unit")
        .when(F.col("base_unit").isNotNull(), "converted")
        .when(F.col("method") == "unknown", "unknown unit")
        .otherwise("counted")
    )
    return joined.select(
        "record_id",
        "spelling",
        "stated_in",
        "base_unit",
        factor.alias("factor"),
        (F.col("base_unit").isNotNull() & (F.col("factor") == "1")).alias("is_base"),
        "method",
        F.when(F.col("base_unit").isNotNull(), value).cast("decimal(38,10)").alias("base_quantity"),
        status.alias("status"),
    )


def needs_conversion(converted: DataFrame) -> DataFrame:
    """Rows of :func:`to_base_units` whose unit is another measure than the base unit, or stated only in text."""
    return converted.filter((F.col("status") == "converted") & (~F.col("is_base") | (F.col("stated_in") != "unit")))
