"""Characters that look like others. Fixed tables, used on distinct values only."""

from __future__ import annotations

import re
import unicodedata

# Cyrillic and Greek letters that are drawn like Latin ones, and those Latin ones.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеосрхуѕіј"
CYRILLIC_AS = "ABESIJKMHOPCTYXaeocpxysij"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"
GREEK_AS = "ABEZHIKMNOPTYXov"
# Hyphens, dashes and the minus sign are one sign.
DASHES = "‐‑‒–—―−﹣－"
# CJK radicals without a compatibility mapping, each before its ideograph.
RADICALS = "⺠民⻁虎⻄西⻅见⻆角⻉贝⻋车⻓长⻔门⻘青⻙韦⻚页⻛风⻜飞⻝食⻢马⻣骨⻤鬼⻥鱼⻦鸟⻧卤⻨麦⻩黄⻬齐⻮齿⻰龙⻳龟"
# The default-ignorable code points of Unicode, by ranges.
IGNORABLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
SPACE = re.compile(r"\s+")

LOOKALIKES = str.maketrans(dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True)) | dict.fromkeys(DASHES, "-") | dict(zip(RADICALS[::2], RADICALS[1::2], strict=True)))


def skeleton(text: str) -> str:
    """The one form of texts that look the same.

    Default-ignorable characters go, compatibility forms become composed ordinary
    ones, look-alike letters become Latin, white space becomes single plain spaces,
    and case is folded in full.
    """
    text = unicodedata.normalize("NFKC", IGNORABLE.sub("", text)).translate(LOOKALIKES)
    folded = unicodedata.normalize("NFKC", text.casefold())
    return SPACE.sub(" ", IGNORABLE.sub("", folded)).strip()
