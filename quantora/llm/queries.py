"""Queries of the training-data operators, and their oracles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.functions import lookalikes
from quantora.llm import leakage, matching, mixing, quality, scans, unify
from quantora.sources.tables import table


def _bills(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines with the project of their period, and the subcontractors' rows."""
    period = table(spark, d, "settlement_periods").select(F.col("id").alias("period_id"), F.col("project_id").alias("_project")).dropDuplicates(["period_id"])
    lines = table(spark, d, "line_items").select("id", "period_id", "code", "name", "feature", "unit", "unit_price").join(period, "period_id")
    rows = table(spark, d, "subcontract_items").select("id", F.col("project_id").alias("_project"), "code", "name", "feature", "unit", "unit_price")
    return lines, rows


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a line and a subcontractor's row that mean the same work item of a project."""
    pairs = matching.match_lines(*_bills(spark, d))
    return pairs.select("line_item_id", F.col("row_id").alias("subcontract_item_id")).distinct()


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every subcontractor's row with the confidence of its match and the lines it covers (none if unmatched)."""
    lines, rows = _bills(spark, d)
    matches, billed = matching.match_items(lines, rows)
    counted = billed.groupBy("project", "item").agg(F.count("*").alias("n_lines"))
    found = matches.join(counted, ["project", "item"]).select(F.col("row_id").alias("subcontract_item_id"), F.round("confidence", 6).alias("confidence"), "n_lines")
    every = rows.select(F.col("id").alias("subcontract_item_id"))
    return every.join(found, "subcontract_item_id", "left").select("subcontract_item_id", "confidence", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are furniture, are cut within a word, or hold a misread character."""
    return scans.scan_noise(table(spark, d, "pdf_pages")).distinct()


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired paragraphs of every file."""
    return scans.paragraphs(table(spark, d, "pdf_pages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Names and units that are not in ordinary characters throughout: they differ from their tidy form, or have none."""
    rows = unify.unify_text(table(spark, d, "line_items"), "id", ["name", "unit"])
    return rows.filter("irregular").select(F.col("record_id").alias("line_item_id"), "field_name").distinct()


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every name and unit in its one form."""
    rows = table(spark, d, "line_items")
    return rows.select(
        F.col("id").alias("line_item_id"),
        unify.unified(F.col("name"), spark)["canonical"].alias("name_canonical"),
        unify.unified(F.col("unit"), spark)["canonical"].alias("unit_canonical"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least half of a held-out item in one unbroken run."""
    leaks = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.filter(F.col("run_chars") * 2 >= F.col("item_chars")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """All leaks, with how much of the item was found and whether it was edited."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual token shares of the mix."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are not natural prose, with what they are."""
    judged = quality.quality(table(spark, d, "documents"), table(spark, d, "common_words"))
    return judged.filter(F.col("kind") != "prose").select("doc_id", "kind").distinct()


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document."""
    judged = quality.quality(table(spark, d, "documents"), table(spark, d, "common_words"))
    return judged.select("doc_id", *[F.round(c, 6).alias(c) if "share" in c or "ratio" in c or "mean" in c else F.col(c) for c in quality.STATISTICS])


_ORDINARY = "\\x{20}-\\x{7E}\\x{4E00}-\\x{9FFF}（），。；：、【】×Φ²³㎡㎥"
_ACCENTED = "".join(sorted(unify.accented_latin()))
_P4_FOUND = " UNION ALL ".join(
    f"SELECT id AS line_item_id, '{f}' AS field_name FROM line_items WHERE regexp_matches({f}, '[^{_ORDINARY}{_ACCENTED}]')" for f in ("name", "unit")
)

# The canonical form in DuckDB's terms: one-to-one replacements, those of more characters, removals, spaces, case.
_ONE_TO_ONE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0x2F00, 0x2FD6), 0xB2, 0xB3, 0xB9, 0x2011)}
_ONE_TO_ONE |= dict(zip(lookalikes.CYRILLIC + lookalikes.GREEK, lookalikes.CYRILLIC_AS + lookalikes.GREEK_AS, strict=True)) | dict.fromkeys(lookalikes.DASHES, "-")
_LONGER = {"㎡": "m2", "㎥": "m3", "Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV"}


def _canonical_sql(c: str) -> str:
    text = f"regexp_replace(nfc_normalize({c}), '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{206F}}\\x{{FEFF}}]', '', 'g')"
    for a, b in _LONGER.items():
        text = f"replace({text}, '{a}', '{b}')"
    quoted = ["".join(x).replace("'", "''") for x in (_ONE_TO_ONE.keys(), _ONE_TO_ONE.values())]
    spaced = f"regexp_replace(translate({text}, '{quoted[0]}', '{quoted[1]}'), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')"
    return f"lower(nfc_normalize(trim({spaced})))"


_P4_CANONICAL = f"SELECT id AS line_item_id, {_canonical_sql('name')} AS name_canonical, {_canonical_sql('unit')} AS unit_canonical FROM line_items"

_P9_STATISTICS = """
WITH w AS (SELECT string_agg(DISTINCT word, '|' ORDER BY length(word) DESC, word) FILTER (WHERE lang = 'zh') AS zh,
                  string_agg(DISTINCT word, '|' ORDER BY length(word) DESC, word) FILTER (WHERE lang <> 'zh') AS en FROM common_words),
 c AS (SELECT doc_id, text AS t, len(regexp_extract_all(text, '[々〇〡-〩\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}]')) AS han,
         len(regexp_extract_all(regexp_replace(text, '[々〇〡-〩\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}]', ' ', 'g'), '[\\p{L}\\p{N}]+')) AS runs,
         len(regexp_extract_all(text, '[\\p{L}\\p{N}]')) AS letters,
         length(regexp_replace(text, '[\\p{L}\\p{N}\\s.,;:!?''"()/%&，。；：！？、“”‘’（）《》【】·—-]', '', 'g')) AS symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS lines,
         len(regexp_extract_all(lower(text), '(?:' || zh || ')|\\b(?:' || en || ')\\b')) AS common
       FROM documents, w)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(han + runs AS BIGINT) AS n_words,
  CASE WHEN han + runs > 0 THEN round(letters / (han + runs), 6) ELSE 0 END AS mean_word_length,
  CASE WHEN length(t) > 0 THEN round(symbols / length(t), 6) ELSE 0 END AS symbol_ratio,
  CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?;:…。！？；：”’"'')）】]\\s*$'))) / len(lines), 6) ELSE 0 END AS punctuated_line_share,
  CASE WHEN han + runs > 0 THEN round(common / (han + runs), 6) ELSE 0 END AS common_word_share
FROM c
"""


def _letters_sql(c: str) -> str:
    """Letters and digits of a text in DuckDB's terms."""
    return f"regexp_replace(lower({_canonical_sql(c)}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_P7_FOUND = f"""
WITH d AS (SELECT doc_id, {_letters_sql('text')} AS t FROM documents),
 i AS (SELECT item_id, {_letters_sql('text')} AS t FROM eval_items),
 w AS (SELECT DISTINCT item_id, substr(t, o, (length(t) + 1) // 2) AS run
       FROM (SELECT item_id, t, unnest(range(1, length(t) - (length(t) + 1) // 2 + 2)) AS o FROM i WHERE t <> ''))
SELECT DISTINCT doc_id, item_id FROM d JOIN w ON contains(d.t, w.run)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_matches": p1_matches,
    "p2_found": p2_found,
    "p2_paragraphs": p2_paragraphs,
    "p4_found": p4_found,
    "p4_canonical": p4_canonical,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_statistics": p9_statistics,
}
ORACLES = {"p4_found": _P4_FOUND, "p4_canonical": _P4_CANONICAL, "p7_found": _P7_FOUND, "p9_statistics": _P9_STATISTICS}
