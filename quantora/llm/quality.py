"""Per-document text statistics, and the kind of text by fixed-threshold rules.

The statistics are column expressions over the whole text and its non-blank lines.
Published thresholds on them (of the MassiveText and FineWeb filters, see below) tell
natural prose from the rest, with a reason per failure. What failed is named by what
most of its lines look like: entries, rows of fields, or neither. One narrow pass
over the documents, no Python, no shuffle; lines are only classed where a rule failed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The MassiveText rules (Rae et al. 2021) on symbols, word length, bullets, stop words and
# repeated lines and stretches, and the FineWeb rule (Penedo et al. 2024) on line endings.
MOST_SYMBOLS, WORD_LENGTH, MOST_BULLETS, STOP_WORDS, MOST_REPEATED_LINES, MOST_REPEATED = 0.1, (3.0, 10.0), 0.9, 2, 0.3, 0.2
LEAST_ENDED = 0.12
#: Own thresholds: the share of common words that prose has at least, where most lines end in punctuation and where few do.
LEAST_COMMON, LEAST_COMMON_OPEN = 0.05, 0.08
#: Own thresholds: letters and digits of a text at least, words for the rules on common words, the share that is most of a text.
LEAST_CHARS, LEAST_WORDS, MAJORITY = 4, 10, 0.5
ENTRY_CHARS = 90
#: The list of common words is built into the expressions; a longer table is refused.
MOST_COMMON_WORDS = 5_000

# Patterns of Java regular expressions.
HAN = "[々〇〡-〩㐀-䶿一-鿿豈-﫿\\x{20000}-\\x{3FFFF}]"
WORD_RUN = f"[\\p{{L}}\\p{{N}}&&[^{HAN[1:-1]}]]+"
LETTER = "[\\p{L}\\p{N}]"
SYMBOL = "[^\\p{L}\\p{N}\\s.,;:!?'\"()/%&，。；：！？、“”‘’（）《》【】·—-]"
ENDING = "[.!?;:…。！？；：”’\"')）】]\\s*$"
BLANKS = "[_＿□☐]"
RULE_LINE = "^[\\s=+*~.#_|:—─…·-]+$"
BULLET = "^\\s*(?:[•◆●■▪◦·*○☐✓>+–—-]\\s*|[(（\\[【]?(?:[0-9]{1,3}|[a-zA-Z]|[一二三四五六七八九十]{1,3}|[ivx]{1,4})[)）.、\\]】]\\s*|[①-⑳]\\s*)(?=\\S)(?![0-9])"
NUMBER_FIELD = "(?:^|[,，;；])\\s*-?[0-9][0-9.]*\\s*(?=[,，;；]|$)"
SHORT_FIELDS = "^[^,，;；。]{1,9}+(?:[,，;；][^,，;；。]{0,9}+){4,}+$"
DELIMITED = "\\t[^\\t]*\\t|\\|[^|]*\\||\\S {2,}\\S(?:[^ ]| (?! ))* {2,}\\S"
FIELD = "^\\s*+[^\\s:：=，。,.;；][^:：=，。,.;；\\t]{0,24}+[:：=\\t]\\s*+\\S[^。]{0,60}$"
FIELD_CHARS = 100
REPEATED = "(.{1,8}?)\\1{11,}"
SENTENCE_BREAK = "[。！？!?]|[.;；，] .*[.;，] "

STATISTICS = ("n_chars", "n_words", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def common_word_pattern(common_words: DataFrame) -> str:
    """One pattern for the words of the small ``common_words`` table (bounded by MOST_COMMON_WORDS)."""
    rows = common_words.select("word").filter(F.col("word").isNotNull()).distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    words = sorted({r.word.strip().lower() for r in rows if r.word.strip()}, key=lambda w: (-len(w), w))
    han = [w for w in words if re.search("[㐀-鿿]", w)]
    latin = [w for w in words if w not in han]
    # Each alternation is entered only at a character that one of its words begins with.
    starts = lambda many: "[" + "".join(sorted({re.escape(w[0]) for w in many})) + "]"
    long, single = [w for w in han if len(w) > 1], [w for w in han if len(w) == 1]
    parts = [f"(?={starts(long)})(?:{'|'.join(map(re.escape, long))})"] if long else []
    parts += [starts(single)] if single else []
    parts += [f"\\b(?={starts(latin)})(?:{'|'.join(map(re.escape, latin))})\\b"] if latin else []
    return "|".join(parts) or "$^"


def counts(text: Column, common: str) -> dict[str, Column]:
    """Raw counts of a text; an ideogram counts as a word, as does a run of other letters and digits."""
    return {
        "n_chars": F.length(text).cast("bigint"),
        "_han": F.regexp_count(text, F.lit(HAN)),
        "_runs": F.regexp_count(text, F.lit(WORD_RUN)),
        "_letters": F.regexp_count(text, F.lit(LETTER)),
        "_symbols": F.regexp_count(text, F.lit(SYMBOL)),
        "_common": F.regexp_count(F.lower(text), F.lit(common)),
    }


def statistics() -> dict[str, Column]:
    """The statistics, from the counts and the line counts."""
    words = (F.col("_han") + F.col("_runs")).cast("bigint")
    ratio = lambda part, whole: _share(F.col(part).cast("double"), F.col(whole).cast("double") if isinstance(whole, str) else whole.cast("double"))
    return {
        "n_words": words,
        "mean_word_length": ratio("_letters", words),
        "symbol_ratio": ratio("_symbols", "n_chars"),
        "punctuated_line_share": ratio("_of.ended", "_lines"),
        "common_word_share": ratio("_common", words),
    }


def _is_entry(x: Column) -> Column:
    """Whether a line is a short bulleted or numbered entry, not a numbered sentence or paragraph."""
    return (F.length(x) <= ENTRY_CHARS) & x.rlike(BULLET) & ~F.regexp_replace(F.trim(x), "[。.;；]+$", "").rlike(SENTENCE_BREAK)


def line_records(text: Column) -> Column:
    """One record per non-blank line: x (the line), n (its characters), whether it is a bullet line, and whether it repeats itself.

    A bullet line is short; numbered paragraphs are none. A line repeats itself if it is
    few tokens, or one short stretch, over and over.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("\\S"))
    split = F.transform(lines, lambda x: F.struct(x.alias("x"), F.trim(x).alias("bare"), F.split(F.trim(x), "[\\s,|]+").alias("t")))
    sized = F.transform(split, lambda y: F.struct(y["x"].alias("x"), F.length(y["bare"]).alias("n"), F.size(y["t"]).alias("size"), F.when(F.size(y["t"]) >= 10, F.size(F.array_distinct(y["t"]))).alias("distinct")))
    repeated = lambda y: F.when((y["distinct"] <= 8) & (y["distinct"] * 3 <= y["size"]) | (y["distinct"] * 12 <= y["size"]), True).otherwise(y["x"].rlike(REPEATED))
    return F.transform(sized, lambda y: F.struct(y["x"].alias("x"), y["n"].alias("n"), ((y["n"] <= ENTRY_CHARS) & y["x"].rlike(BULLET)).alias("bullet"), repeated(y).alias("repeated")))


def line_counts(lines: Column) -> dict[str, Column]:
    """From the line records: lines, those below a heading, those that end in punctuation, are bullets, or equal another; characters, and those of lines that repeat themselves."""
    first = F.get(lines, F.lit(0))
    heading = F.when((F.size(lines) > 1) & (first["n"] <= ENTRY_CHARS) & ~first["bullet"], 1).otherwise(0)
    sums = F.aggregate(
        lines,
        F.struct(*[F.lit(0).alias(k) for k in ("ended", "bullets", "chars", "repetitive")]),
        lambda a, y: F.struct(
            (a["ended"] + y["x"].rlike(ENDING).cast("int")).alias("ended"),
            (a["bullets"] + y["bullet"].cast("int")).alias("bullets"),
            (a["chars"] + y["n"]).alias("chars"),
            (a["repetitive"] + F.when(y["repeated"], y["n"]).otherwise(0)).alias("repetitive"),
        ),
    )
    equal = F.size(lines) - F.size(F.array_distinct(F.transform(lines, lambda y: y["x"])))
    return {"_lines": F.size(lines), "_below_heading": F.size(lines) - heading, "_equal": equal, "_of": sums}


def _line_class(y: Column) -> Column:
    """What the line of a record looks like: form, rule, filler, table, field, entry or text. The cheap tests come first."""
    x = y["x"]
    fields = (F.regexp_count(x, F.lit("[,，;；]")) >= 3) & ~F.contains(x, F.lit("。")) & (F.regexp_count(x, F.lit(NUMBER_FIELD)) >= 2)
    form = x.rlike(BLANKS) & (F.length(F.regexp_replace(x, "[^\\p{L}\\p{N}]", "")) <= 3 * F.regexp_count(x, F.lit(BLANKS)) + 2)
    return (
        F.when(x.rlike(RULE_LINE), "rule")
        .when(form, "form")
        .when(y["repeated"], "filler")
        .when(x.rlike(DELIMITED) | x.rlike(SHORT_FIELDS) | fields, "table")
        .when(_is_entry(x), "entry")
        .when((F.length(x) <= FIELD_CHARS) & x.rlike(FIELD), "field")
        .otherwise("text")
    )


LINE_CLASSES = ("rule", "form", "filler", "table", "field", "entry", "text")


def class_chars(lines: Column) -> Column:
    """A struct with the characters in lines of each class."""
    marked = F.transform(lines, lambda y: F.struct(_line_class(y).alias("c"), y["n"].alias("n")))
    return F.aggregate(
        marked,
        F.struct(*[F.lit(0).alias(c) for c in LINE_CLASSES]),
        lambda acc, x: F.struct(*[(acc[c] + F.when(x["c"] == c, x["n"]).otherwise(0)).alias(c) for c in LINE_CLASSES]),
    )


def failures(has_common: bool) -> list[tuple[str, Column]]:
    """(reason, test) of every rule that natural prose keeps."""
    latin = F.col("_han") * 4 < F.col("n_words")
    worded = F.lit(has_common) & (F.col("n_words") >= LEAST_WORDS)
    part = lambda a, b: _share(F.col(a).cast("double"), F.col(b).cast("double"))
    open_ended = (F.col("punctuated_line_share") <= LEAST_ENDED) & (F.lit(not has_common) | (F.col("common_word_share") < LEAST_COMMON_OPEN))
    return [
        ("no text", F.col("_letters") < LEAST_CHARS),
        ("too many symbols", F.col("symbol_ratio") > MOST_SYMBOLS),
        ("overlong words", F.col("mean_word_length") > WORD_LENGTH[1]),
        ("fragments of words", latin & (F.col("mean_word_length") < WORD_LENGTH[0])),
        ("bullet lines", (F.col("_of.bullets") > 1) & (part("_of.bullets", "_below_heading") > MOST_BULLETS)),
        ("repeated lines", part("_equal", "_lines") > MOST_REPEATED_LINES),
        ("repeated filler", part("_of.repetitive", "_of.chars") > MOST_REPEATED),
        ("fewer than two stop words", worded & (F.col("_common") < STOP_WORDS)),
        ("hardly any common words", worded & (F.col("common_word_share") < LEAST_COMMON)),
        ("few lines end in punctuation", open_ended & (F.col("_lines") > 1)),
    ]


def kind_of() -> Column:
    """What most of a text is, by the characters of its line classes (``_c``)."""
    total = sum((F.col(f"_c.{c}") for c in LINE_CLASSES), F.lit(0))
    most = lambda *cs: _share(sum((F.col(f"_c.{c}") for c in cs), F.lit(0)).cast("double"), total.cast("double")) >= MAJORITY
    return (
        F.when((F.col("_letters") < LEAST_CHARS) | most("form", "rule", "filler"), "junk")
        .when(most("table", "rule") | most("field", "table", "rule"), "table")
        .when(most("entry") | most("entry", "field", "table"), "list")
        .otherwise("junk")
    )


def quality(documents: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, kind and reasons of every document.

    Columns: doc_id, the STATISTICS, ``kind`` (prose, list, table or junk) and
    ``reasons`` (the rules of :func:`failures` that the text does not keep, in their
    order; empty for prose).

    Defined cases: a null text counts as empty, and an empty text is junk (reason
    ``no text``); texts of any length are read whole; a repeated row gives a repeated
    result row; a null doc_id stays null; other columns are not read; an empty table
    gives no rows; without common words the stop-word rules are not applied.
    """
    pattern = common_word_pattern(common_words)
    # Each generator keeps the optimizer from copying what is below it into the rules and filters above.
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", "_text", F.explode(F.array(line_records(F.col("_text")))).alias("_own"))
    measures = counts(F.col("_text"), pattern) | line_counts(F.col("_own"))
    rows = rows.select("doc_id", "_own", F.inline(F.array(F.struct(*[c.alias(k) for k, c in measures.items()]))))
    rows = rows.withColumns(statistics())
    failed = F.array_compact(F.array(*[F.when(test, why) for why, test in failures(pattern != "$^")]))
    judged = rows.select("doc_id", *STATISTICS, "_own", "_letters", F.explode(F.array(failed)).alias("reasons"))
    classed = judged.select("doc_id", *STATISTICS, "_letters", "reasons", F.explode(F.array(F.when(F.size("reasons") > 0, class_chars(F.col("_own"))))).alias("_c"))
    return classed.select("doc_id", *STATISTICS, F.when(F.size("reasons") == 0, "prose").otherwise(kind_of()).alias("kind"), "reasons")
