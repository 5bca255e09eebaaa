"""Queries of the quantity ledger: effective contexts, their conflicts, buildings, and two ceilings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.functions.numbers import TOTAL
from quantora.operators import ledger
from quantora.plans.domain import as_double, boq, boq_and, dbl
from quantora.sources.tables import table

IDENTITY = ["project_id", "direction", "contract_key", "business_period_no"]


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """A counting context of each settlement period; what the period table lacks is made from ids, as in :data:`CONTEXTS`."""
    i = F.col("id")
    return table(spark, d, "settlement_periods").select(
        "id", "project_id", "direction", F.coalesce("contract_party", F.lit("")).alias("contract_key"), (F.col("period_no") - F.when(i % 8 == 0, 1).otherwise(0)).alias("business_period_no"),
        F.when(i % 5 == 0, "cumulative").otherwise("incremental").alias("mode"), F.when(i % 10 == 0, "draft").otherwise("confirmed").alias("status"), F.when(i % 6 == 0, i - 1).alias("supersedes_id"),
    )


def effective_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The effective contexts, with whether another has the same business identity."""
    return ledger.identity_conflicts(ledger.effective_contexts(contexts(spark, d)), IDENTITY).select("id", "mode", "conflict")


def scope_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Directions of a project whose effective contexts count in different modes."""
    rows = ledger.effective_contexts(contexts(spark, d)).withColumn("period_no", F.col("business_period_no"))
    return ledger.scope_modes(rows, ["project_id", "direction"]).select("project_id", "direction", "mode", "conflict")


def open_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Lines that could still change a conclusion: their period has no clear context, or their quantity cannot be read."""
    from quantora.plans.sheets import typed_lines

    clear = ledger.identity_conflicts(ledger.effective_contexts(contexts(spark, d)), IDENTITY).filter("not conflict").select(F.col("id").alias("period_id"), F.lit(True).alias("_clear"))
    lines = typed_lines(spark, d).filter("not is_subtotal").select("line_id", "period_id", "quantity")
    why = F.when(F.col("_clear").isNull(), "no context").when(F.col("quantity").isNull(), "no quantity")
    return lines.join(clear, "period_id", "left").select("line_id", why.alias("reason")).filter("reason is not null")


def _built(spark: SparkSession, d: str) -> DataFrame:
    """Items with a building (by supplier number) and their identity; rows with number 2 have a key given by hand."""
    manual = F.when((F.col("line_no") == 2) & (F.col("code") != ""), F.concat(F.lit("K"), F.col("code")))
    return boq(spark, d).withColumn("building", F.split_part("rid", F.lit("-"), F.lit(4)).cast("int") % 7).withColumn("item", ledger.identity(manual))


def identity_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How items are identified, with the items and rows of each kind: by hand, description, code or name."""
    return _built(spark, d).groupBy(F.split_part("item", F.lit("|"), F.lit(1)).alias("kind")).agg(F.count_distinct("item").alias("n_items"), F.count("*").alias("n_rows"))


def building_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The buildings that each item stands in, and whether there is more than one."""
    g = _built(spark, d).groupBy("item", "building").agg(F.count("*").alias("n"))
    return g.groupBy("item").agg(F.count("*").alias("n_buildings"), F.max_by("building", F.struct("n", -F.col("building"))).alias("likeliest"), (F.count("*") > 1).alias("conflict"))


def ledger_buildings(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of each direction and item per building and over all."""
    rows = ledger.rollup_buildings(_built(spark, d).filter("item like 'desc|%'"), ["direction", "item"])
    return rows.select("direction", "item", "building", "over_all", "n_rows", as_double(F.col("quantity")).alias("quantity"), "n_missing")


def ledger_two_ceilings(spark: SparkSession, d: str) -> DataFrame:
    """Downward quantities of each code against what the contract allows and what was settled upward.

    The contract's ceiling is the upward quantity of the first half of the periods
    times two, one contributor per unit; the settled one is all of the upward quantity.
    """
    rows = boq(spark, d).filter("code <> ''")
    q = F.sum(F.col("quantity").cast(TOTAL))
    whole = F.when(F.count_if(F.col("quantity").isNull()) == 0, q)
    side = lambda test, value: rows.filter(test).groupBy("code").agg(value.alias("quantity"), F.count_distinct("unit").alias("n"))
    used = side("direction = 'downward' and not is_deduction", q)
    contract = side("direction = 'upward' and period_no <= 14 and not is_deduction", 2 * q)
    settled = side("direction = 'upward'", whole)
    pending = rows.filter("direction = 'downward' and quantity is null").select("code")
    out = ledger.two_ceilings(used, contract, settled, pending, ["code"])
    return out.select("code", *[as_double(F.col(f"{p}_quantity")).alias(f"{p}_quantity") for p in ("used", "contract", "settled")], "contract_verdict", "settled_verdict", "worst", "reason")


CONTEXTS = """c AS (SELECT id, project_id, direction, coalesce(contract_party, '') AS contract_key, period_no - CASE WHEN id % 8 = 0 THEN 1 ELSE 0 END AS business_period_no, CASE WHEN id % 5 = 0 THEN 'cumulative' ELSE 'incremental' END AS mode,
  CASE WHEN id % 10 = 0 THEN 'draft' ELSE 'confirmed' END AS status, CASE WHEN id % 6 = 0 THEN id - 1 END AS supersedes_id FROM settlement_periods),
 e AS (SELECT *, count(*) OVER (PARTITION BY project_id, direction, contract_key, business_period_no) > 1 AS conflict FROM c WHERE status = 'confirmed' AND id NOT IN (SELECT supersedes_id FROM c WHERE status = 'confirmed' AND supersedes_id IS NOT NULL))"""
_COMPACT = "lower(regexp_replace({c}, '\\s', '', 'g'))"
_ITEM = f"CASE WHEN line_no = 2 AND code <> '' THEN 'manual|K' || code ELSE 'desc|' || {_COMPACT.format(c='name')} || '|' || {_COMPACT.format(c='feature')} || '|' || CASE WHEN unit IN ('kg', 't') THEN 't' ELSE unit END END"
_BUILT = f"b AS (SELECT *, CAST(split_part(rid, '-', 4) AS INTEGER) % 7 AS building, {_ITEM} AS item FROM boq)"
_VERDICT = """CASE WHEN {p}.code IS NULL THEN 'PENDING' WHEN {p}.n > 1 THEN 'CONTROL_CONFLICT' WHEN {p}.q IS NULL OR (u.code IS NOT NULL AND u.q IS NULL) THEN 'PENDING' WHEN u.code IS NULL THEN 'PASS' WHEN u.q > {p}.q THEN 'FAIL' WHEN o.code IS NOT NULL THEN 'PENDING' ELSE 'PASS' END"""
ORACLES = {
    "effective_contexts": f"WITH {CONTEXTS} SELECT id, mode, conflict FROM e",
    "scope_conflicts": f"WITH {CONTEXTS} SELECT project_id, direction, CASE WHEN count(DISTINCT mode) = 1 THEN min(mode) END AS mode, count(DISTINCT mode) > 1 AS conflict FROM e GROUP BY ALL",
    "open_quantities": f"""WITH {CONTEXTS}, l AS (SELECT id, period_id, __QUANTITY__ AS quantity FROM line_items WHERE NOT coalesce(json_extract_string(flags_json, '$.subtotal') = 'true', false))
        SELECT l.id AS line_id, CASE WHEN e.id IS NULL THEN 'no context' ELSE 'no quantity' END AS reason FROM l LEFT JOIN (SELECT id FROM e WHERE NOT conflict) e ON e.id = l.period_id WHERE e.id IS NULL OR l.quantity IS NULL""",
    "identity_kinds": boq_and(_BUILT, "SELECT split_part(item, '|', 1) AS kind, count(DISTINCT item) AS n_items, count(*) AS n_rows FROM b GROUP BY 1"),
    "building_candidates": boq_and(_BUILT, "SELECT item, count(*) AS n_buildings, arg_max(building, (n, -building)) AS likeliest, count(*) > 1 AS conflict FROM (SELECT item, building, count(*) AS n FROM b GROUP BY ALL) GROUP BY item"),
    "ledger_buildings": boq_and(
        _BUILT,
        f"""SELECT direction, item, building, CAST(grouping(building) AS INTEGER) = 1 AS over_all, count(*) AS n_rows, CASE WHEN count(*) = count(quantity) THEN {dbl("sum(quantity * CASE unit WHEN 'kg' THEN 0.001 ELSE 1 END)")} END AS quantity, count(*) - count(quantity) AS n_missing
        FROM b WHERE item LIKE 'desc|%' GROUP BY GROUPING SETS ((direction, item, building), (direction, item))""",
    ),
    "ledger_two_ceilings": boq_and(
        f"""r AS (SELECT * FROM boq WHERE code <> ''), u AS (SELECT code, sum(quantity) AS q, count(DISTINCT unit) AS n FROM r WHERE direction = 'downward' AND NOT is_deduction GROUP BY code),
        c AS (SELECT code, 2 * sum(quantity) AS q, count(DISTINCT unit) AS n FROM r WHERE direction = 'upward' AND period_no <= 14 AND NOT is_deduction GROUP BY code),
        s AS (SELECT code, CASE WHEN count(*) = count(quantity) THEN sum(quantity) END AS q, count(DISTINCT unit) AS n FROM r WHERE direction = 'upward' GROUP BY code),
        o AS (SELECT DISTINCT code FROM r WHERE direction = 'downward' AND quantity IS NULL), k AS (SELECT code FROM u UNION SELECT code FROM c UNION SELECT code FROM s),
        v AS (SELECT k.code, u.q AS uq, c.q AS cq, s.q AS sq, u.code IS NOT NULL AS hu, c.code IS NOT NULL AS hc, s.code IS NOT NULL AS hs, o.code IS NOT NULL AS ho, {_VERDICT.format(p='c')} AS cv, {_VERDICT.format(p='s')} AS sv
              FROM k LEFT JOIN u ON u.code = k.code LEFT JOIN c ON c.code = k.code LEFT JOIN s ON s.code = k.code LEFT JOIN o ON o.code = k.code),
        w AS (SELECT *, CASE WHEN 'FAIL' IN (cv, sv) THEN 'FAIL' WHEN 'CONTROL_CONFLICT' IN (cv, sv) THEN 'CONTROL_CONFLICT' WHEN 'PENDING' IN (cv, sv) THEN 'PENDING' ELSE 'PASS' END AS worst FROM v)""",
        f"""SELECT code, {dbl('uq')} AS used_quantity, {dbl('cq')} AS contract_quantity, {dbl('sq')} AS settled_quantity, cv AS contract_verdict, sv AS settled_verdict, worst,
        CASE WHEN worst = 'PASS' THEN 'within both ceilings' WHEN worst = 'FAIL' THEN 'ceiling exceeded' WHEN worst = 'CONTROL_CONFLICT' THEN 'several ceilings' WHEN NOT hc AND NOT hs THEN 'no ceiling' WHEN NOT hc THEN 'no contract ceiling' WHEN NOT hs THEN 'no settled ceiling'
        WHEN hu AND uq IS NULL THEN 'quantity missing' WHEN ho THEN 'open rows' ELSE 'ceiling without quantity' END AS reason FROM w""",
    ),
}


def _read_quantity() -> str:
    from quantora.plans.documents import _sql_decimal

    return _sql_decimal("quantity")


ORACLES["open_quantities"] = ORACLES["open_quantities"].replace("__QUANTITY__", _read_quantity())
QUERIES = {name: globals()[name] for name in ORACLES}
