"""Numbers typed as text: exact decimals, or missing. Missing is never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms of the characters that occur in figures, and their plain forms.
_WIDE = "０１２３４５６７８９．，（）－＋％　￥＄"
_PLAIN = "0123456789.,()-+% ¥$"
# Characters that never show and are dropped before a figure is read.
INVISIBLE = "[\\u00AD\\u200B-\\u200F\\u2060-\\u2064\\uFEFF]"
#: Widths for exact arithmetic: inputs, products of two inputs, sums.
INPUT, PRODUCT, TOTAL = "decimal(18,6)", "decimal(37,12)", "decimal(38,12)"


def plain_figures(c: Column) -> Column:
    """Full-width digits and signs as plain ones, invisible characters removed, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(c, INVISIBLE, ""), _WIDE, _PLAIN), "(?U)\\s+", " "))


def decimal_text(c: Column) -> Column:
    """The figure of a text as plain decimal notation, or null if the text is not one figure.

    Separators, spaces, currency signs, a leading 人民币 and a trailing 元 are dropped;
    ``(x)`` is negative. Percentages, words, placeholders and anything else give null.
    """
    bare = F.regexp_replace(plain_figures(c), "[,\\s¥￥$€£]|^人民币|元$", "")
    signed = F.regexp_replace(F.regexp_replace(bare, "^\\(([^()+-]*)\\)$", "-$1"), "^\\+", "")
    return F.nullif(F.regexp_extract(signed, "^(-?(?=\\.?[0-9])[0-9]*\\.?[0-9]*)$", 1), F.lit(""))


def to_decimal(c: Column, kind: str = INPUT) -> Column:
    """:func:`decimal_text` as a decimal; null where it is missing or too wide."""
    return decimal_text(c).try_cast(kind)


def canonical_number(c: Column) -> Column:
    """One spelling per value: ``1,200.50`` and ``¥1200.5`` agree; null and empty are null.

    Texts that are no figure keep their own (trimmed) text, so that they differ from
    every figure and from each other.
    """
    short = F.regexp_replace(F.regexp_replace(decimal_text(c), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    whole = F.regexp_replace(F.regexp_replace(short, "^(-?)0+(?=[0-9.])", "$1"), "^(?=\\.|$)|(?<=^-)(?=\\.|$)", "0")
    return F.coalesce(F.regexp_replace(whole, "^-(?=0$)", ""), F.nullif(plain_figures(c), F.lit("")))


def to_percent(c: Column) -> Column:
    """``13%`` as 0.13; other figures as they are."""
    flat = F.regexp_replace(plain_figures(c), "\\s", "")
    share = to_decimal(F.regexp_replace(flat, "%$", ""))
    return F.when(flat.endswith("%"), (share / F.lit(100)).cast("decimal(18,8)")).otherwise(to_decimal(c).cast("decimal(18,8)"))


def tax_fraction(c: Column) -> Column:
    """Tax rates in any notation as a fraction: ``13%``, ``13`` and ``0.13`` are 0.13."""
    share = to_percent(c)
    return F.when(share > 1, (share / F.lit(100)).cast("decimal(18,8)")).otherwise(share)


def round2(c: Column) -> Column:
    """Two decimals, half away from zero."""
    return F.round(c, 2)


def within(a: Column, b: Column, tolerance: str = "0.02") -> Column:
    """``|a - b| <= tolerance``, null if either is missing."""
    return F.abs(a - b) <= F.lit(tolerance).cast("decimal(6,4)")


def percent_number(c: Column) -> Column:
    """A figure that stands for per cent as a fraction: 13 is 0.13."""
    return (to_decimal(c) / F.lit(100)).cast("decimal(20,8)")


def difference_rate(left: Column, right: Column) -> Column:
    """(right - left) / left: nothing against nothing is 0, anything against nothing has no rate."""
    difference = right - left
    return F.when(left != 0, F.try_divide(difference.cast("double"), left.cast("double"))).when(difference == 0, F.lit(0.0))
