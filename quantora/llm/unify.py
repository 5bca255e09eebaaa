"""Texts that look the same, brought to one form.

The work is done on the distinct values of each Arrow batch: compatibility forms
become composed ordinary ones, white space becomes plain, default-ignorable
characters go, look-alike letters become Latin, and case is folded in full. Which
characters look alike is taken from the published Unicode table of confusables, as
the ICU library in Spark's own class path holds it. The result is spread back to the
rows, so the operator is narrow: no shuffle, no join.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.functions.lookalikes import IGNORABLE, LOOKALIKES, SPACE

# The characters that count as ordinary besides accented Latin letters.
ORDINARY_RANGES = ((0x20, 0x7E), (0x4E00, 0x9FFF))
ORDINARY_MARKS = "（），。；：、【】×Φ²³㎡㎥"
# The blocks that hold precomposed Latin letters.
LATIN_BLOCKS = ((0x00C0, 0x024F), (0x1E00, 0x1EFF))

KINDS = ("invisible", "space", "accent", "lookalike", "compatibility", "other")


@lru_cache(1)
def accented_latin() -> frozenset[str]:
    """Precomposed letters: one Latin letter and combining marks, by their canonical decomposition."""
    found = set()
    for low, high in LATIN_BLOCKS:
        for code in range(low, high + 1):
            parts = unicodedata.normalize("NFD", chr(code))
            if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all(map(unicodedata.combining, parts[1:])):
                found.add(chr(code))
    return frozenset(found)


@lru_cache(1 << 16)
def is_ordinary(ch: str) -> bool:
    """Whether a character needs no other form."""
    return any(low <= ord(ch) <= high for low, high in ORDINARY_RANGES) or ch in ORDINARY_MARKS or ch in accented_latin()


_TABLES: dict[str, dict[int, str]] = {}


def confusables(spark: SparkSession) -> dict[int, str]:
    """Letters and marks of all scripts that are drawn like an ASCII character, and that character.

    The published prototypes make no difference between I and l; a capital stands for
    the capital that its small letter is drawn like. Compatibility forms are left to
    normalisation and ordinary characters to themselves. The table is as large as
    Unicode makes it (some hundred entries) and is asked for once per application.
    """
    key = spark.sparkContext.applicationId
    if key not in _TABLES:
        looks = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
        every = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "LPS"]
        every = [ch for ch in every if not is_ordinary(ch) and unicodedata.normalize("NFKC", ch) == ch]
        lower = [ch.lower() for ch in every]
        own, small = looks("\n".join(every)).split("\n"), looks("\n".join(lower)).split("\n")
        table = {}
        for ch, low, as_own, as_small in zip(every, lower, own, small, strict=True):
            if ch != low and as_own == "l":
                as_own = as_small.upper()
            if len(as_own) == 1 and as_own.isascii() and as_own.isalpha() == (unicodedata.category(ch)[0] == "L"):
                table[ord(ch)] = as_own
        _TABLES[key] = table | LOOKALIKES
    return _TABLES[key]


def oddity(ch: str, table: dict[int, str]) -> str | None:
    """What is odd about a character, or None if it is ordinary."""
    if is_ordinary(ch):
        return None
    if IGNORABLE.match(ch):
        return "invisible"
    if ch.isspace():
        return "space"
    if unicodedata.combining(ch):
        return "accent"
    if ord(ch) in table:
        return "lookalike"
    if unicodedata.normalize("NFKC", ch) != ch:
        return "compatibility"
    return "other"


def tidy_form(value: str, table: dict[int, str]) -> str:
    """The value in ordinary characters: composed, and each odd character replaced by the one it is drawn like.

    Ordinary marks and signs, spacing and case stay as they are, so a value of
    ordinary characters is its own tidy form.
    """
    out = []
    for ch in unicodedata.normalize("NFC", value):
        if not is_ordinary(ch):
            ch = "" if IGNORABLE.match(ch) else " " if ch.isspace() else table.get(ord(ch)) or unicodedata.normalize("NFKC", ch).translate(table)
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def canonical_form(value: str, table: dict[int, str]) -> str:
    """The one form for comparison: compatibility composed, look-alikes Latin, case folded in full, single plain spaces."""
    text = unicodedata.normalize("NFKC", IGNORABLE.sub("", value)).translate(table)
    folded = unicodedata.normalize("NFKC", text.casefold())
    return SPACE.sub(" ", IGNORABLE.sub("", folded)).strip()


def unify_value(value: str, table: dict[int, str]) -> tuple[str, str, bool, list[str]]:
    """(canonical form, tidy form, whether the value is not in ordinary characters, the kinds of its odd ones in the order of KINDS)."""
    tidy = tidy_form(value, table)
    irregular = tidy != value or not all(map(is_ordinary, tidy))
    odd = {oddity(ch, table) for ch in set(value)} if irregular else set()
    return canonical_form(value, table), tidy, irregular, [k for k in KINDS if k in odd]


_UNIFIED = "canonical string, tidy string, irregular boolean, odd array<string>"


def unified(c: Column, spark: SparkSession) -> Column:
    """A struct of the text's canonical and tidy forms, whether it is irregular, and its odd characters' kinds."""
    table = confusables(spark)

    def run(values: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(values)
        done = [*(unify_value(v, table) for v in distinct), (None, None, None, None)]
        return pd.DataFrame([done[i] for i in codes], columns=["canonical", "tidy", "irregular", "odd"])

    return F.pandas_udf(run, _UNIFIED)(c.cast("string"))


def unify_text(rows: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """One row per record and field: record_id, field_name, value, canonical, tidy, irregular, odd.

    ``canonical`` is for comparison, ``tidy`` for display; ``irregular`` says that the
    value is not its own tidy form or has characters without an ordinary form, and
    ``odd`` names the kinds of its odd characters.

    Defined cases: a null value has null forms, flag and kinds; an empty text is its
    own form; texts of any length are read whole; a repeated row gives repeated result
    rows; other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value"), unified(F.col(f), spark).alias("u")) for f in fields])
    return rows.select(F.col(record_id).alias("record_id"), F.explode(each).alias("r")).select("record_id", "r.field_name", "r.value", "r.u.*")
