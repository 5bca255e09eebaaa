"""Units of measure: a fixed vocabulary, and the reading of other spellings by it."""

from __future__ import annotations

import re
from collections import defaultdict
from decimal import Decimal
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantora.functions.lookalikes import skeleton

# Names of units by base unit and factor (a decimal text).
MEASURES = {
    "t": {
        "1": "t 吨 公吨 tonne tonnes",
        "0.001": "kg kgs 公斤 千克 kilogram",
        "0.000001": "g 克 gram",
        "0.000000001": "mg 毫克",
        "0.0005": "斤 市斤",
        "0.00045359237": "lb lbs 磅",
    },
    "m": {
        "1": "m 米 延米 延长米 公尺 metre meter",
        "0.001": "mm 毫米",
        "0.01": "cm 厘米 公分",
        "0.1": "dm 分米",
        "1000": "km 公里 千米",
        "0.3048": "ft 英尺",
        "0.0254": "in 英寸",
        "0.9144": "yd 码",
    },
    "m2": {
        "1": "m2 平方米 平米 平方 sqm",
        "0.000001": "mm2 平方毫米",
        "0.0001": "cm2 平方厘米",
        "0.01": "dm2 平方分米",
        "1000000": "km2 平方公里 平方千米",
        "10000": "ha 公顷 hectare",
        "666.66666666667": "亩 mu",
        "0.09290304": "sqft ft2 平方英尺",
    },
    "m3": {
        "1": "m3 立方米 立米 立方 方 cbm cum",
        "0.001": "l 升 公升 litre liter dm3 立方分米",
        "0.000001": "ml 毫升 cm3 立方厘米",
        "0.028316846592": "cuft ft3 立方英尺",
    },
}
# Things that are counted, not measured.
COUNTED = "台 樘 项 个 套 件 根 块 组 处 座 只 棵 株 副 批 次 天 日 工日 台班 张 份 扇 片 条 对 系统 点 点位 部 间 户 人 月 年 元 把 面 樁 桩 孔 口 节 盏 set sets pcs pc no nos ea each item ls lot day days unit units %"
# Multiples written before a unit.
MULTIPLES = {"十": "10", "百": "100", "千": "1000", "万": "10000"}
# The cost of an edit relative to a plain one, for look-alike pairs and for signs.
CONFUSED = {frozenset(p): 0.3 for p in ("1l", "1i", "il", "0o", "2z", "5s", "未米", "采米", "末米", "顷项", "屯吨", "干千", "士土")}
SIGN_COST, PLAIN_COST = 0.2, 1.0
#: A spelling is read as a vocabulary entry if the edits cost at most this share of its length.
TOLERANCE = 0.34


def unit_key(text: str) -> str:
    """A spelling without look-alikes, case, spaces, exponent marks, dots and brackets."""
    return re.sub(r"[\s^.·*\[\]()（）【】]", "", skeleton(text))


@lru_cache(1)
def vocabulary() -> dict[str, tuple[str | None, str]]:
    """Every name with its base unit and factor; counted things have no base unit."""
    names = {unit_key(n): (base, factor) for base, by in MEASURES.items() for factor, many in by.items() for n in many.split()}
    return {unit_key(n): (None, "1") for n in COUNTED.split()} | names


def grams(word: str) -> set[str]:
    """Character bigrams with marked borders."""
    padded = f"^{word}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


@lru_cache(1)
def gram_index() -> dict[str, set[str]]:
    """The inverted index of the vocabulary: bigram to names."""
    index: dict[str, set[str]] = defaultdict(set)
    for name in vocabulary():
        for g in grams(name):
            index[g].add(name)
    return index


def _cost(a: str, b: str) -> float:
    if a == b:
        return 0.0
    return CONFUSED.get(frozenset((a, b)), PLAIN_COST)


def weighted_distance(a: str, b: str) -> float:
    """Edit distance with cheap look-alike substitutions and cheap signs."""
    row = [0.0]
    for ch in b:
        row.append(row[-1] + (PLAIN_COST if ch.isalnum() else SIGN_COST))
    for x in a:
        gap = PLAIN_COST if x.isalnum() else SIGN_COST
        new = [row[0] + gap]
        for j, y in enumerate(b):
            new.append(min(row[j] + _cost(x, y), row[j + 1] + gap, new[j] + (PLAIN_COST if y.isalnum() else SIGN_COST)))
        row = new
    return row[-1]


def _fuzzy(key: str) -> tuple[str, float] | None:
    """The vocabulary name nearest to a key, if it is near enough and no other meaning is as near."""
    names = vocabulary()
    near = {n for g in grams(key) for n in gram_index().get(g, ()) if abs(len(n) - len(key)) <= 2}
    scored = sorted((weighted_distance(key, n), n) for n in near)
    if not scored or scored[0][0] > TOLERANCE * len(key):
        return None
    best = scored[0][0]
    if len({names[n] for d, n in scored if d <= best + 0.15}) > 1:
        return None
    return scored[0][1], best


def read_unit(text: str) -> tuple[str | None, str | None, str, float]:
    """(base unit, factor, method, distance) of a spelling.

    The base unit is null for counted things and for spellings that mean nothing; the
    method tells them apart: ``exact``, ``multiple``, ``fuzzy``, or ``unknown``.
    """
    key = unit_key(text)
    names = vocabulary()
    if not key:
        return None, None, "unknown", 0.0
    if key in names:
        return *names[key], "exact", 0.0
    factor, rest = Decimal(1), key
    if m := re.match(r"(\d+)(?=\D)", rest):
        factor, rest = Decimal(m[1]), rest[m.end() :]
    while rest not in names and rest[:1] in MULTIPLES and len(rest) > 1:
        factor, rest = factor * Decimal(MULTIPLES[rest[0]]), rest[1:]
    if factor > 0 and rest in names:
        base, own = names[rest]
        return base, format(factor * Decimal(own), "f"), "multiple", 0.0
    if found := _fuzzy(rest):
        base, own = names[found[0]]
        return base, format(factor * Decimal(own), "f"), "fuzzy", found[1]
    return None, None, "unknown", 0.0


# Units that rules take for one (case counts), and those that comparisons and exports take for one.
RULE_UNITS = {"m3": "m³ 立方米 立米 M3 m^3", "m2": "m² 平方米 平米 M2 m^2", "m": "米 延长米", "t": "吨 T", "kg": "千克 公斤", "个": "只 件", "樘": "堂 樘/处"}
RADAR_UNITS = {"m3": "m³ 立方米 立米 m^3", "m2": "m² 平方米 平米 m^2"}
EXPORT_UNITS = {"m3": "m³ 立方米 立米 M3 m^3", "m2": "m² 平方米 平米 M2 m^2"}


def _renamed(c: Column, names: dict[str, str]) -> Column:
    pairs = [(alias, name) for name, many in names.items() for alias in many.split()]
    return F.coalesce(F.create_map(*[F.lit(x) for p in pairs for x in p])[c], c)


def rule_unit(c: Column) -> Column:
    """A unit for the rules: aliases of one unit are one, without scale and with case; empty for none."""
    return _renamed(F.trim(F.coalesce(c, F.lit(""))), RULE_UNITS)


def radar_unit(c: Column) -> Column:
    """A unit for period differences: in lower case, areas and volumes under one name."""
    return _renamed(F.lower(F.trim(F.coalesce(c, F.lit("")))), RADAR_UNITS)


def export_unit(c: Column) -> Column:
    """A unit for exports: areas and volumes under one name, the rest as it is."""
    return _renamed(F.trim(F.coalesce(c, F.lit(""))), EXPORT_UNITS)


def converted_quantity(quantity: Column, factor: Column, target: Column) -> Column:
    """A quantity by a stated factor into a target unit, and on into the target's base (kg by 0.001)."""
    base = F.when(F.lower(F.trim(target)) == "kg", F.lit("0.001")).otherwise(F.lit("1")).cast("decimal(6,3)")
    return (quantity * factor.cast("decimal(18,6)") * base).cast("decimal(38,9)")
