"""Text functions of the domain: ordinals, period numbers, buildings, sentences, percentages, tax basis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chinese digits.
_DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def chinese_ordinal(c: Column) -> Column:
    """一 to 九十九 as 1 to 99, else null."""
    table = F.create_map(*[x for k, v in _DIGITS.items() for x in (F.lit(k), F.lit(v))])
    tens = F.regexp_extract(c, "^([一二三四五六七八九]?)十", 1)
    ones = F.regexp_extract(c, "^(?:[一二三四五六七八九]?十)?([一二三四五六七八九])$", 1)
    has_ten = c.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$")
    value = F.when(has_ten, F.coalesce(table[F.nullif(tens, F.lit(""))], F.lit(1)) * 10 + F.coalesce(table[F.nullif(ones, F.lit(""))], F.lit(0)))
    return F.when(c.rlike("^[一二三四五六七八九]$"), table[c]).otherwise(value)


def period_number(c: Column) -> Column:
    """The number of 第N期, in digits or Chinese, or of a plain ``period N``; null without one."""
    zh = F.regexp_extract(c, "第\\s*([0-9一二三四五六七八九十]+)\\s*期", 1)
    en = F.regexp_extract(c, "(?i)period\\s+([0-9]+)", 1)
    lone = F.regexp_extract(c, "^([0-9]+)期", 1)
    return F.coalesce(zh.try_cast("int"), chinese_ordinal(zh), en.try_cast("int"), lone.try_cast("int"))


def building_tokens(c: Column) -> Column:
    """The buildings a text names: 3号楼, 1-3号楼 (a range) and 1、2号楼 (a list), as sorted numbers."""
    plain = F.translate(F.regexp_replace(c, "#\\s*楼|号楼|栋", "号楼"), "０１２３４５６７８９－～—", "0123456789---")
    groups = F.regexp_extract_all(plain, F.lit("([0-9]+(?:[、,，~-][0-9]+)*)号楼"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, "[、,，]")))
    expand = lambda p: F.when(
        p.rlike("^[0-9]{1,3}[~-][0-9]{1,3}$"),
        F.sequence(F.least(F.split_part(F.translate(p, "~", "-"), F.lit("-"), F.lit(1)).try_cast("int"), F.split_part(F.translate(p, "~", "-"), F.lit("-"), F.lit(2)).try_cast("int")), F.split_part(F.translate(p, "~", "-"), F.lit("-"), F.lit(2)).try_cast("int")),
    ).otherwise(F.array(p.try_cast("int")))
    numbers = F.flatten(F.transform(parts, expand))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))


def sentences(c: Column) -> Column:
    """The non-empty sentences of a text."""
    return F.filter(F.transform(F.split(c, "[。；;！!？?\\n]"), lambda s: F.trim(s)), lambda s: s != "")


def percentages(c: Column) -> Column:
    """All percentages of a text as numbers: 3%, 3 %, 3个点, 百分之三."""
    plain = F.transform(F.regexp_extract_all(c, F.lit("([0-9]+(?:\\.[0-9]+)?)\\s*(?:%|％|个点|percent)"), F.lit(1)), lambda x: x.try_cast("double"))
    words = F.transform(F.regexp_extract_all(c, F.lit("百分之([一二三四五六七八九十]+)"), F.lit(1)), lambda x: chinese_ordinal(x).cast("double"))
    return F.concat(plain, words)


def tax_basis(c: Column) -> Column:
    """exclusive, inclusive or unknown, as a header or note states it."""
    return F.when(c.rlike("不含税|税前|(?i)excl(?:uding|\\.)?\\s*(?:tax|vat)"), "exclusive").when(c.rlike("(?<!不)含税|税后|(?i)incl(?:uding|\\.)?\\s*(?:tax|vat)"), "inclusive").otherwise("unknown")


def direction_label(c: Column) -> Column:
    """A label of a direction."""
    return F.when(c == "upward", "to the owner").when(c == "downward", "to subcontractors").otherwise("unknown")


def compact_text(c: Column) -> Column:
    """A text without white space, in lower case; empty for none."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", ""))


def compact_code(c: Column) -> Column:
    """A code trimmed and in lower case; empty for none."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def tax_comparable(a: Column, b: Column) -> Column:
    """COMPARABLE if two tax bases agree, PENDING if either is unknown, else INCOMPARABLE."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return F.when((known(a) == "unknown") | (known(b) == "unknown"), "PENDING").when(a == b, "COMPARABLE").otherwise("INCOMPARABLE")


def looks_numeric(c: Column) -> Column:
    """Whether a cell holds a figure, whatever currency sign or brackets stand around it."""
    return F.coalesce(F.regexp_replace(F.trim(c), "[¥￥()（）]", "").rlike("^[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?%?$"), F.lit(False))


def looks_code(c: Column) -> Column:
    """Whether a cell holds a code: Latin letters, digits and joints, with a digit among them."""
    bare = F.regexp_replace(c, "(?U)\\s+", "")
    return F.coalesce(bare.rlike("^[0-9A-Za-z][0-9A-Za-z._/-]*$") & bare.rlike("[0-9]"), F.lit(False))


def tax_only(c: Column) -> Column:
    """Whether a row is a tax amount and nothing else."""
    return F.coalesce(F.regexp_replace(F.trim(c), " ", "").rlike("^(?:税金|税额|税费|增值税)(?:[（(].*[）)])?$"), F.lit(False))


def level_label(c: Column) -> Column:
    """Whether a text numbers or names a level of a hierarchy: 一, （一）, 1.1, 第二部分, 其中."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", "")
    return bare.rlike("^(?:[一二三四五六七八九十百]+|[（(][一二三四五六七八九十百]+[)）]|第?[一二三四五六七八九十0-9]+部分|[0-9]{1,3}(?:\\.[0-9]{1,3})+|其中|合同内|合同外|开累)$")


# What sheet names tell of the kind of their list, in order of precedence.
LIST_KINDS = (
    ("unit price measures", "单价措施"),
    ("total price measures", "总价措施|措施项目"),
    ("bill of quantities", "分部分项|工程量清单"),
    ("upward details", "对上|业主"),
    ("downward details", "对下|分包"),
    ("other fees", "其他|规费|暂列"),
    ("no business", "封面|目录|说明"),
    ("summary", "汇总|台账"),
)


def list_kind(c: Column) -> Column:
    """The kind of list that a sheet name suggests, or unknown."""
    kind = F.lit("unknown")
    for name, pattern in reversed(LIST_KINDS):
        kind = F.when(c.rlike(pattern), name).otherwise(kind)
    return kind


def summary_like(c: Column) -> Column:
    """Whether a sheet name is one of summaries, settlements or ledgers."""
    return F.coalesce(c.rlike("(?i)汇总|核销|台账|summary|reconciliation|ledger"), F.lit(False))


def building_groups(c: Column) -> Column:
    """The building statements of a text as written, ranges and lists apart: ``3``, ``1-3``, ``1、2``."""
    plain = F.translate(F.regexp_replace(c, "#\\s*楼|号楼|栋", "号楼"), "０１２３４５６７８９－～—", "0123456789---")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit("([0-9]+(?:[、,，~-][0-9]+)*)号楼"), F.lit(1)))


def building_verdict(groups: Column) -> Column:
    """struct(building, status) of all statements of a row's sources.

    One single building is accepted; one range or list stands for itself and is not
    split; several of either, or both kinds, are in conflict; none is unconfirmed.
    """
    single = F.filter(groups, lambda g: g.rlike("^[0-9]+$"))
    combined = F.filter(groups, lambda g: ~g.rlike("^[0-9]+$"))
    one = lambda a: F.get(a, F.lit(0))
    status = (
        F.when((F.size(single) > 0) & (F.size(combined) > 0), "mixed sources").when(F.size(combined) > 1, "conflict").when(F.size(combined) == 1, "combined").when(F.size(single) == 1, "accepted").when(F.size(single) > 1, "conflict").otherwise("unconfirmed")
    )
    return F.struct(F.when(status == "accepted", one(single)).when(status == "combined", one(combined)).alias("building"), status.alias("status"))


def sheet_row_id(sha256: Column, sheet: Column, row: Column) -> Column:
    """An identity of a row that outlives runs: the file's digest, the sheet's name as JSON text, the row's number; null if any is unusable."""
    name = F.regexp_replace(F.regexp_replace(F.trim(sheet), "\\\\", "\\\\\\\\"), '"', '\\\\"')
    good = F.trim(sha256).rlike("^[0-9a-fA-F]{64}$") & (F.trim(sheet) != "") & (row >= 1)
    return F.when(good, F.concat(F.lit("sha256:"), F.lower(F.trim(sha256)), F.lit('|sheet:"'), name, F.lit('"|row:'), row.cast("string")))
