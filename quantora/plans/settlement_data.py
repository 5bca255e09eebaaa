"""Queries over the settlement tables: orphan references, base units, snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.functions.units import MEASURES, MULTIPLES, unit_key
from quantora.operators.measures import needs_conversion, to_base_units
from quantora.operators.orphans import Child, Parent, find_orphans, orphan_report
from quantora.operators.snapshots import snapshot_changes
from quantora.sources.tables import table


def _parents(spark: SparkSession, d: str) -> list[Parent]:
    return [
        Parent("settlement_periods", table(spark, d, "settlement_periods"), "id", "registered_at", "deleted_at"),
        Parent("raw_sheets", table(spark, d, "raw_sheets"), "id", "loaded_at", "deleted_at"),
        Parent("evidence", table(spark, d, "evidence"), "id", "created_at", "deleted_at"),
    ]


def _children(lines: DataFrame, anomalies: DataFrame, lines_extra: dict, anomalies_extra: dict) -> list[Child]:
    return [
        Child("line_items", lines, "id", "loaded_at", {"period_id": "settlement_periods", "sheet_id": "raw_sheets"}, lines_extra),
        Child("anomalies", anomalies, "id", "created_at", {"evidence_id": "evidence"}, anomalies_extra),
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference with its reason."""
    return find_orphans(_children(table(spark, d, "line_items"), table(spark, d, "anomalies"), {}, {}), _parents(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans per table, field and settlement period.

    An anomaly belongs to the period it is about, or to the period of its line item;
    anomalies about sheets have none.
    """
    lines = table(spark, d, "line_items")
    periods = lines.select(F.col("id").alias("_line"), F.col("period_id").cast("bigint").alias("_line_period"))
    anomalies = table(spark, d, "anomalies").select("id", "created_at", "evidence_id", "subject_type", "subject_id")
    about_line = F.when(F.col("subject_type") == "line_item", F.col("subject_id"))
    placed = anomalies.withColumn("_line", about_line).join(periods, "_line", "left")
    period = F.when(F.col("subject_type") == "period", F.col("subject_id")).otherwise(F.col("_line_period"))
    children = _children(lines, placed, {"_period": F.col("period_id").cast("bigint")}, {"_period": period.cast("bigint")})
    return orphan_report(children, _parents(spark, d), "_period")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose quantity stands in another measure than the base unit, or whose unit stands only in text."""
    found = needs_conversion(to_base_units(table(spark, d, "line_items")))
    return found.select(F.col("record_id").alias("line_item_id"), "base_unit").distinct()


def p5_quantities(spark: SparkSession, d: str) -> DataFrame:
    """All lines with their quantity in the base unit."""
    rows = to_base_units(table(spark, d, "line_items"))
    return rows.select(
        F.col("record_id").alias("line_item_id"), "spelling", "stated_in", "base_unit", "base_quantity", "status"
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Records added, removed or changed between consecutive snapshots."""
    return snapshot_changes(table(spark, d, "project_versions"), table(spark, d, "project_version_items"))


_REF_ROWS = """
  SELECT 'line_items' AS table_name, 'period_id' AS field_name, l.id AS record_id, l.period_id AS key, l.loaded_at AS at_, l.period_id AS period_id,
         p.id AS pid, p.deleted_at AS gone, p.registered_at AS came
  FROM line_items l LEFT JOIN settlement_periods p ON p.id = l.period_id WHERE l.period_id IS NOT NULL
  UNION ALL
  SELECT 'line_items', 'sheet_id', l.id, l.sheet_id, l.loaded_at, l.period_id, s.id, s.deleted_at, s.loaded_at
  FROM line_items l LEFT JOIN raw_sheets s ON s.id = l.sheet_id WHERE l.sheet_id IS NOT NULL
  UNION ALL
  SELECT 'anomalies', 'evidence_id', a.id, a.evidence_id, a.created_at,
         CASE WHEN a.subject_type = 'period' THEN a.subject_id WHEN a.subject_type = 'line_item' THEN l.period_id END,
         e.id, e.deleted_at, e.created_at
  FROM anomalies a LEFT JOIN evidence e ON e.id = a.evidence_id
  LEFT JOIN line_items l ON a.subject_type = 'line_item' AND l.id = a.subject_id WHERE a.evidence_id IS NOT NULL
"""
_REASON = "CASE WHEN pid IS NULL THEN 'missing' WHEN gone IS NOT NULL THEN 'deleted' WHEN came > at_ THEN 'late' END"

_P3_FOUND = f"WITH r AS ({_REF_ROWS}) SELECT table_name, field_name, record_id, {_REASON} AS reason FROM r WHERE {_REASON} IS NOT NULL"
_P3_REPORT = f"""
WITH r AS ({_REF_ROWS}), c AS (SELECT *, {_REASON} AS reason FROM r)
SELECT table_name, field_name, CAST(period_id AS BIGINT) AS period_id, count(*) AS n_references,
       count(*) FILTER (WHERE reason = 'missing') AS n_missing,
       count(*) FILTER (WHERE reason = 'deleted') AS n_deleted,
       count(*) FILTER (WHERE reason = 'late') AS n_late
FROM c GROUP BY ALL
"""

_SQL_INVISIBLE = "[\\x{00AD}\\x{200B}-\\x{200F}\\x{2060}-\\x{2064}\\x{FEFF}]"


def _sql_figure(c: str) -> str:
    """A text figure as a DuckDB decimal."""
    flat = f"translate(regexp_replace({c}, '{_SQL_INVISIBLE}', '', 'g'), '０１２３４５６７８９．，（）－', '0123456789.,()-')"
    return f"TRY_CAST(regexp_replace(regexp_replace({flat}, '[,\\s¥￥元\\x{{00A0}}\\x{{3000}}]', '', 'g'), '^\\((.*)\\)$', '-\\1') AS DECIMAL(30,8))"


_P6_FOUND = f"""
WITH v AS (SELECT project_id, id, version_no, snapshot_sha256 AS sha,
                  lag(id) OVER w AS prev_id, lag(snapshot_sha256) OVER w AS prev_sha
           FROM project_versions WINDOW w AS (PARTITION BY project_id ORDER BY version_no)),
 pairs AS (SELECT * FROM v WHERE prev_id IS NOT NULL),
 i AS (SELECT version_id, identity_key, occurrence, min({_sql_figure('unit_price')}) AS price, min({_sql_figure('amount')}) AS amount
       FROM project_version_items GROUP BY ALL),
 nxt AS (SELECT p.project_id, p.version_no, p.id, i.* EXCLUDE (version_id) FROM pairs p JOIN i ON i.version_id = p.id),
 prv AS (SELECT p.project_id, p.version_no, p.id, i.* EXCLUDE (version_id) FROM pairs p JOIN i ON i.version_id = p.prev_id)
SELECT coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.version_no, o.version_no) AS version_no,
       coalesce(n.identity_key, o.identity_key) AS identity_key, coalesce(n.occurrence, o.occurrence) AS occurrence,
       CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM nxt n FULL OUTER JOIN prv o ON n.id = o.id AND n.identity_key = o.identity_key AND n.occurrence = o.occurrence
WHERE o.id IS NULL OR n.id IS NULL OR n.price IS DISTINCT FROM o.price OR n.amount IS DISTINCT FROM o.amount
"""

# The alias list of the oracle is written out from the fixed vocabulary of units.
_ALIASES = ", ".join(
    f"('{unit_key(n)}', '{base}', {factor})" for base, by in MEASURES.items() for factor, names in by.items() for n in names.split()
)
_CHARACTERS = ("０１２３４５６７８９ｍＭｔＴｋＫｇＧｃｄｈｂｓｑｆａ²³МТТсаКΜΤΚ⽶⽴⽅⼟．，（）－", "0123456789mmttkkggcdhbsqfa23mttcakmtk米立方土.,()-")


def _sql_flat(c: str) -> str:
    squares = f"replace(replace(regexp_replace({c}, '{_SQL_INVISIBLE}', '', 'g'), '㎡', 'm2'), '㎥', 'm3')"
    return f"trim(regexp_replace(translate({squares}, '{_CHARACTERS[0]}', '{_CHARACTERS[1]}'), '[\\s\\x{{00A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}]+', ' ', 'g'))"


_P5_FOUND = f"""
WITH alias(name, base, factor) AS (VALUES {_ALIASES}),
 flat AS (SELECT id, {_sql_flat('quantity')} AS q, nullif({_sql_flat('unit')}, '') AS u, {_sql_flat('feature')} AS f FROM line_items),
 parts AS (SELECT id, u AS field, q,
    nullif(regexp_extract(q, '^[^0-9见附第#]*([0-9][0-9,]*(\\.[0-9]+)?)\\s*\\)?\\s*[\\[(]?\\s*(.*?)\\s*[\\])]?$', 3), '') AS after_q,
    nullif(coalesce(nullif(regexp_extract(f, '(计量单位|单位|unit)\\s*[:：]\\s*([^;；,，()]+)', 2), ''),
             nullif(regexp_extract(f, '按([^;；,，()按]+?)计量', 1), ''),
             nullif(regexp_extract(f, '以([^;；,，()以]+?)计', 1), ''),
             nullif(regexp_extract(f, '【([^】]+)】\\s*计', 1), '')), '') AS stated
   FROM flat WHERE regexp_matches(q, '^[^0-9见附第#]*[0-9]')),
 spelled AS (SELECT id, field, lower(regexp_replace(coalesce(field, after_q, stated), '[\\s^]', '', 'g')) AS s FROM parts),
 split AS (SELECT id, field, s, regexp_extract(s, '^([0-9]+)', 1) AS digits, regexp_replace(s, '^[0-9]+', '') AS rest FROM spelled),
 resolved AS (
   SELECT id, field, coalesce(a.base, b.base, c.base) AS base,
     CASE WHEN a.base IS NOT NULL AND digits = '' THEN a.factor = 1 ELSE false END AS is_base
   FROM split
   LEFT JOIN alias a ON a.name = s
   LEFT JOIN alias b ON a.name IS NULL AND b.name = rest
   LEFT JOIN alias c ON a.name IS NULL AND b.name IS NULL AND left(rest, 1) IN ({', '.join(f"'{m}'" for m in MULTIPLES)}) AND c.name = substr(rest, 2))
SELECT id AS line_item_id, base AS base_unit FROM resolved WHERE base IS NOT NULL AND (field IS NULL OR NOT is_base)
"""

QUERIES = {
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p5_found": p5_found,
    "p5_quantities": p5_quantities,
    "p6_found": p6_found,
}
ORACLES = {"p3_found": _P3_FOUND, "p3_report": _P3_REPORT, "p5_found": _P5_FOUND, "p6_found": _P6_FOUND}
