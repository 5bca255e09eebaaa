"""Aggregation queries over the items and the findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.functions.numbers import TOTAL
from quantora.operators import aggregate as agg
from quantora.plans.domain import EFFECTIVE, KEY, as_double, boq, boq_and, dbl, effective, item_key, over_boq
from quantora.sources.tables import table

#: Periods that a pivot may have as columns.
MOST_PERIODS = 1_000
NORM = "lower(regexp_replace(feature, '\\s', '', 'g'))"
BASIS = "CASE WHEN unit IN ('t', 'kg') THEN 't' ELSE unit END"
FACTOR = "CASE WHEN unit = 'kg' THEN 0.001 ELSE 1 END"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return boq(spark, d).withColumn("item_key", item_key())


def item_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative settlement of each item and direction."""
    rows = agg.cumulate(_keyed(spark, d), ["direction", "item_key"])
    return rows.select(
        "direction", "item_key", "n_items", as_double(F.col("total")).alias("total"), as_double(F.col("raw_total")).alias("raw_total"),
        as_double(F.col("calculated_used")).alias("calculated_used"), "n_missing", "n_derived", "n_mismatch", "source", "check_status",
        as_double(F.col("quantity")).alias("quantity"), "base_unit", "average_price", "status",
    )


def item_period_totals(spark: SparkSession, d: str) -> DataFrame:
    """Effective amount of each item per period, with the count of rows that have none."""
    rows = _keyed(spark, d).filter(~F.col("is_deduction"))
    return rows.groupBy("direction", "period_no", "item_key").agg(
        F.count("*").alias("n_rows"), as_double(F.sum(effective())).alias("total"), F.count_if(effective().isNull()).alias("n_missing")
    )


def amount_assessment(spark: SparkSession, d: str) -> DataFrame:
    """Each row's effective amount, where it comes from, and whether it checks."""
    rows = agg.assess_amount(boq(spark, d))
    return rows.select("rid", as_double(F.col("effective"), 6).alias("effective"), "amount_source", "amount_check")


def quantity_unit_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Quantities in one base unit per item, refused where measures or features mix."""
    rows = agg.normalised_quantity(_keyed(spark, d), ["direction", "item_key"])
    return rows.select("direction", "item_key", as_double(F.col("quantity")).alias("quantity"), "base_unit", "status")


def settlement_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Effective amounts of each item and direction, periods as columns; the periods are those of the data."""
    rows = _keyed(spark, d).filter(~F.col("is_deduction")).withColumn("effective", effective())
    periods = sorted(r.period_no for r in rows.select("period_no").distinct().limit(MOST_PERIODS + 1).collect())
    if len(periods) > MOST_PERIODS:
        raise ValueError(f"more than {MOST_PERIODS} periods; use item_period_totals")
    wide = rows.groupBy("direction", "item_key").pivot("period_no", periods).agg(F.sum("effective"))
    return wide.select("direction", "item_key", *[as_double(F.col(str(p))).alias(f"p{p:02d}") for p in periods])


def direction_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Items by status and the total of what is available, per direction."""
    rows = agg.cumulate(_keyed(spark, d), ["direction", "item_key"])
    return rows.groupBy("direction").agg(
        F.count("*").alias("n_items"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "incomplete", "incomparable")],
        as_double(F.sum("total")).alias("available"),
    )


def direction_counts(spark: SparkSession, d: str) -> DataFrame:
    """Periods per direction; a missing direction is unknown."""
    return table(spark, d, "settlement_periods").groupBy(F.coalesce(F.nullif(F.trim("direction"), F.lit("")), F.lit("unknown")).alias("direction")).agg(F.count("*").alias("n_periods"))


def risk_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Findings by severity and status, by each alone, and in total: one pass, four groupings."""
    rows = table(spark, d, "anomalies")
    cube = rows.cube("severity", "status").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return cube.select("severity", "status", "level", "n")


def period_detail_counts(spark: SparkSession, d: str) -> DataFrame:
    """Detail and subtotal rows of each settlement period, also of periods without rows."""
    flag = F.get_json_object("flags_json", "$.subtotal")
    lines = table(spark, d, "line_items").select(F.col("period_id").alias("id"), F.coalesce(flag == "true", F.lit(False)).alias("sub"))
    counts = lines.groupBy("id").agg(F.count_if(~F.col("sub")).alias("n_detail"), F.count_if(F.col("sub")).alias("n_subtotal"))
    periods = table(spark, d, "settlement_periods").select("id", "direction")
    return periods.join(counts, "id", "left").select(F.col("id").alias("period_id"), "direction", F.coalesce("n_detail", F.lit(0)).alias("n_detail"), F.coalesce("n_subtotal", F.lit(0)).alias("n_subtotal"))


def single_value_groups(spark: SparkSession, d: str) -> DataFrame:
    """A group's price if it has one row and one price; its quantity only if no row lacks one."""
    rows = _keyed(spark, d).groupBy("direction", "period_no", "item_key").agg(
        F.when((F.count("*") == 1) & (F.count_distinct("unit_price") == 1), F.max("unit_price")).alias("price"),
        F.when(F.count_if(F.col("quantity").isNull()) == 0, F.sum(F.col("quantity").cast(TOTAL))).alias("quantity"),
    )
    return rows.select("direction", "period_no", "item_key", as_double(F.col("price")).alias("price"), as_double(F.col("quantity")).alias("quantity"))


def price_median(spark: SparkSession, d: str) -> DataFrame:
    """Exact median, lowest and highest price of each name, feature and unit."""
    rows = agg.exact_median(boq(spark, d), ["name", "feature", "unit"], "unit_price")
    return rows.select("name", "feature", "unit", "n", as_double(F.col("lowest")).alias("lowest"), as_double(F.col("highest")).alias("highest"), "median")


def price_hint(spark: SparkSession, d: str) -> DataFrame:
    """Each item's last price against the comparable earlier ones: sample, range, median, deviation, its rate, and reasons."""
    rows = boq(spark, d).filter(F.col("code") != "")
    latest = rows.groupBy("direction", "code", "unit").agg(F.max("period_no").alias("last"), F.max_by("unit_price", F.struct("period_no", "rid")).alias("price"))
    history = rows.select("direction", "code", "unit", "period_no", F.col("amount").isNotNull().alias("stated"), F.try_divide(F.col("amount").cast("double"), F.col("quantity").cast("double")).alias("paid"))
    known = history.join(latest, ["direction", "code", "unit"]).filter(F.col("period_no") < F.col("last"))
    usable = F.col("stated") & F.col("paid").isNotNull()
    stats = known.groupBy("direction", "code", "unit").agg(
        F.count("*").alias("n_sample"),
        F.count_if(usable).alias("n_comparable"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("stated"), "no amount").when(F.col("paid").isNull(), "no quantity"))), ",").alias("reasons"),
    )
    median = agg.exact_median(known.filter(usable), ["direction", "code", "unit"], "paid").drop("n")
    joined = latest.join(stats, ["direction", "code", "unit"]).join(median, ["direction", "code", "unit"], "left")
    deviation = F.col("price").cast("double") - F.col("median")
    return joined.select("direction", "code", "unit", "n_sample", "n_comparable", (F.col("n_sample") - F.col("n_comparable")).alias("n_incomparable"), "reasons", "lowest", "highest", "median", deviation.alias("deviation"), F.try_divide(deviation, F.col("median")).alias("rate"))


def content_digests(spark: SparkSession, d: str) -> DataFrame:
    """A content digest of each direction and period."""
    return agg.content_digest(boq(spark, d), ["direction", "period_no"], ["rid", "code", "name", "unit"])


def row_set_hashes(spark: SparkSession, d: str) -> DataFrame:
    """A digest of the set of rows of each sheet, whatever their order and number."""
    lines = table(spark, d, "line_items").select("sheet_id", F.get_json_object("flags_json", "$.row").cast("int").alias("row")).filter("sheet_id is not null and row is not null")
    return lines.groupBy("sheet_id").agg(F.size(F.collect_set("row")).alias("n_rows"), F.sha2(F.array_join(F.array_sort(F.collect_set("row")), ","), 256).alias("row_hash"))


def finding_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which of all rules have findings in each project: complete, partial, or none."""
    findings = table(spark, d, "anomalies").select("project_id", "rule_id").filter(F.col("rule_id").isNotNull())
    expected = findings.select("rule_id").distinct()
    n = expected.agg(F.count("*").alias("n_expected"))
    per = findings.distinct().groupBy("project_id").agg(F.count("*").alias("n_seen"))
    projects = table(spark, d, "settlement_periods").select("project_id").distinct()
    joined = projects.join(per, "project_id", "left").join(F.broadcast(n))  # one row
    seen = F.coalesce("n_seen", F.lit(0))
    return joined.select("project_id", "n_expected", seen.alias("n_seen"), F.when(seen == 0, "none").when(seen < F.col("n_expected"), "partial").otherwise("complete").alias("coverage"))


def severity_maximum(spark: SparkSession, d: str) -> DataFrame:
    """The worst severity of each project and subject, by rank."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    rows = table(spark, d, "anomalies").select("project_id", "subject_type", F.col("severity"), rank.alias("_r"))
    return rows.groupBy("project_id", "subject_type").agg(F.max_by("severity", "_r").alias("worst"), F.count("*").alias("n"))


def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Pair counting of a grouping by name and feature against the grouping by code: precision, recall, F1, false-positive rate.

    Pairs are counted from group sizes, never listed.
    """
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_name", "p_type").alias("predicted"), F.concat_ws("|", "p_name", "p_brand").alias("truth"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = parts.groupBy("predicted", "truth").agg(F.count("*").alias("n")).agg(pairs("n").alias("tp"))
    own = parts.groupBy("predicted").agg(F.count("*").alias("n")).agg(pairs("n").alias("p"))
    real = parts.groupBy("truth").agg(F.count("*").alias("n")).agg(pairs("n").alias("t"))
    total = parts.agg(F.count("*").alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).alias("all"))
    one = both.join(own).join(real).join(total)  # single rows
    ratio = lambda a, b: F.round(F.try_divide(a, b), 4)
    precision, recall = F.try_divide(F.col("tp"), F.col("p")), F.try_divide(F.col("tp"), F.col("t"))
    fp = F.col("p") - F.col("tp")
    return one.select(
        F.col("tp").cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"), (F.col("t") - F.col("tp")).cast("bigint").alias("fn"), (F.col("all") - F.col("t") - fp).cast("bigint").alias("tn"),
        ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("t")).alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), ratio(fp, F.col("all") - F.col("t")).alias("fpr"),
    )


_AMT = f"""
 a AS (SELECT *, {KEY} AS item_key, quantity * unit_price AS calc, {EFFECTIVE} AS eff FROM boq WHERE NOT is_deduction),
 s AS (SELECT *, CASE WHEN amount IS NOT NULL THEN 'raw' WHEN calc IS NOT NULL THEN 'calculated' ELSE 'missing' END AS src,
        CASE WHEN amount IS NULL OR calc IS NULL THEN 'not_available' WHEN abs(amount - calc) <= 0.02 THEN 'match' ELSE 'diff' END AS chk,
        {BASIS} AS base, quantity * {FACTOR} AS std FROM a),
 g AS (SELECT direction, item_key, count(*) AS n_items, sum(eff) AS total, sum(amount) AS raw_total, sum(calc) FILTER (WHERE src = 'calculated') AS calculated_used,
        count(*) FILTER (WHERE src = 'missing') AS n_missing, count(*) FILTER (WHERE src = 'calculated') AS n_derived, count(*) FILTER (WHERE chk = 'diff') AS n_mismatch,
        CASE WHEN bool_or(src = 'raw') AND bool_or(src = 'calculated') THEN 'mixed' WHEN bool_or(src = 'raw') THEN 'raw' WHEN bool_or(src = 'calculated') THEN 'calculated' ELSE 'missing' END AS source,
        CASE WHEN bool_or(chk = 'diff') THEN 'diff' WHEN bool_or(chk = 'match') THEN 'match' ELSE 'not_available' END AS check_status,
        count(*) FILTER (WHERE amount IS NULL OR quantity IS NULL) AS open_,
        CASE WHEN count(DISTINCT base) > 1 OR count(DISTINCT {NORM}) > 1 THEN 'incomparable' WHEN count(*) FILTER (WHERE std IS NULL) > 0 THEN 'incomplete' ELSE 'ok' END AS q,
        sum(std) AS qsum, CASE WHEN count(DISTINCT base) = 1 THEN min(base) END AS base_unit FROM s GROUP BY ALL),
 c AS (SELECT *, CASE WHEN q = 'ok' THEN qsum END AS quantity,
        CASE WHEN q <> 'ok' THEN q WHEN open_ > 0 OR n_mismatch > 0 THEN 'incomplete' WHEN qsum = 0 THEN 'incomparable' ELSE 'ok' END AS status FROM g)
"""

ORACLES = {
    "item_cumulative": boq_and(
        _AMT,
        f"""SELECT direction, item_key, n_items, {dbl('total')} AS total, {dbl('raw_total')} AS raw_total, {dbl('calculated_used')} AS calculated_used, n_missing, n_derived, n_mismatch,
        source, check_status, {dbl('quantity')} AS quantity, base_unit, CAST(CAST(total AS DECIMAL(38,12)) AS DOUBLE) / nullif(CAST(quantity AS DOUBLE), 0) AS average_price, status FROM c""",
    ),
    "item_period_totals": over_boq(
        f"SELECT direction, period_no, {KEY} AS item_key, count(*) AS n_rows, {dbl(f'sum({EFFECTIVE})')} AS total, count(*) FILTER (WHERE {EFFECTIVE} IS NULL) AS n_missing FROM boq WHERE NOT is_deduction GROUP BY ALL"
    ),
    "amount_assessment": over_boq(
        f"""SELECT rid, {dbl(EFFECTIVE, 6)} AS effective, CASE WHEN amount IS NOT NULL THEN 'raw' WHEN quantity IS NOT NULL THEN 'calculated' ELSE 'missing' END AS amount_source,
        CASE WHEN amount IS NULL OR quantity IS NULL THEN 'not_available' WHEN abs(amount - quantity * unit_price) <= 0.02 THEN 'match' ELSE 'diff' END AS amount_check FROM boq"""
    ),
    "quantity_unit_normalised": boq_and(
        f"k AS (SELECT *, {KEY} AS item_key, {BASIS} AS base, quantity * {FACTOR} AS std FROM boq)",
        f"""SELECT direction, item_key, CASE WHEN count(DISTINCT base) = 1 AND count(DISTINCT {NORM}) = 1 AND count(*) = count(std) THEN {dbl('sum(std)')} END AS quantity,
        CASE WHEN count(DISTINCT base) = 1 THEN min(base) END AS base_unit,
        CASE WHEN count(DISTINCT base) > 1 OR count(DISTINCT {NORM}) > 1 THEN 'incomparable' WHEN count(*) > count(std) THEN 'incomplete' ELSE 'ok' END AS status FROM k GROUP BY ALL""",
    ),
    "settlement_pivot": over_boq(
        f"SELECT direction, {KEY} AS item_key, " + ", ".join(f"{dbl(f'sum({EFFECTIVE}) FILTER (WHERE period_no = {p})')} AS p{p:02d}" for p in range(1, 29)) + " FROM boq WHERE NOT is_deduction GROUP BY ALL"
    ),
    "direction_amounts": boq_and(
        _AMT,
        f"SELECT direction, count(*) AS n_items, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'incomplete') AS n_incomplete, count(*) FILTER (WHERE status = 'incomparable') AS n_incomparable, {dbl('sum(total)')} AS available FROM c GROUP BY ALL",
    ),
    "direction_counts": "SELECT coalesce(nullif(trim(direction), ''), 'unknown') AS direction, count(*) AS n_periods FROM settlement_periods GROUP BY ALL",
    "risk_grouping_sets": "SELECT severity, status, CAST(grouping(severity, status) AS INTEGER) AS level, count(*) AS n FROM anomalies GROUP BY GROUPING SETS ((severity, status), (severity), (status), ())",
    "period_detail_counts": """SELECT p.id AS period_id, p.direction, count(l.id) FILTER (WHERE NOT coalesce(json_extract_string(l.flags_json, '$.subtotal') = 'true', false)) AS n_detail,
        count(l.id) FILTER (WHERE coalesce(json_extract_string(l.flags_json, '$.subtotal') = 'true', false)) AS n_subtotal
        FROM settlement_periods p LEFT JOIN line_items l ON l.period_id = p.id GROUP BY ALL""",
    "single_value_groups": over_boq(
        f"SELECT direction, period_no, {KEY} AS item_key, CASE WHEN count(*) = 1 THEN {dbl('max(unit_price)')} END AS price, CASE WHEN count(*) = count(quantity) THEN {dbl('sum(quantity)')} END AS quantity FROM boq GROUP BY ALL"
    ),
    "price_median": over_boq(
        f"""SELECT name, feature, unit, count(*) AS n, {dbl('min(unit_price)')} AS lowest, {dbl('max(unit_price)')} AS highest, {dbl('median(unit_price)')} AS median FROM boq GROUP BY ALL"""
    ),
    "price_hint": boq_and(
        """r AS (SELECT * FROM boq WHERE code <> ''), l AS (SELECT direction, code, unit, max(period_no) AS last, arg_max(unit_price, (period_no, rid)) AS price FROM r GROUP BY ALL),
        k AS (SELECT r.direction, r.code, r.unit, l.price, r.amount IS NOT NULL AS stated, CAST(r.amount AS DOUBLE) / CAST(r.quantity AS DOUBLE) AS paid
              FROM r JOIN l USING (direction, code, unit) WHERE r.period_no < l.last),
        m AS (SELECT direction, code, unit, CAST(sum(paid) AS DOUBLE) / count(*) AS median FROM
          (SELECT *, row_number() OVER (PARTITION BY direction, code, unit ORDER BY paid) AS r, count(*) OVER (PARTITION BY direction, code, unit) AS n FROM k WHERE stated AND paid IS NOT NULL)
          WHERE r IN ((n + 1) // 2, (n + 2) // 2) GROUP BY ALL)""",
        """SELECT direction, code, unit, count(*) AS n_sample, count(*) FILTER (WHERE stated AND paid IS NOT NULL) AS n_comparable,
        coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN NOT stated THEN 'no amount' WHEN paid IS NULL THEN 'no quantity' END) FILTER (WHERE NOT stated OR paid IS NULL)), ','), '') AS reasons,
        count(*) FILTER (WHERE NOT stated OR paid IS NULL) AS n_incomparable, min(paid) FILTER (WHERE stated) AS lowest, max(paid) FILTER (WHERE stated) AS highest,
        max(m.median) AS median, CAST(max(price) AS DOUBLE) - max(m.median) AS deviation, (CAST(max(price) AS DOUBLE) - max(m.median)) / max(m.median) AS rate FROM k LEFT JOIN m USING (direction, code, unit) GROUP BY direction, code, unit""",
    ),
    "content_digests": boq_and(
        """h AS (SELECT direction, period_no, sha256(rid || '|' || code || '|' || name || '|' || unit) AS h FROM boq),
        b AS (SELECT direction, period_no, substr(h, 1, 3) AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM h GROUP BY ALL)""",
        "SELECT direction, period_no, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM b GROUP BY ALL",
    ),
    "row_set_hashes": """WITH r AS (SELECT DISTINCT sheet_id, CAST(json_extract_string(flags_json, '$.row') AS INTEGER) AS row FROM line_items WHERE sheet_id IS NOT NULL)
        SELECT sheet_id, count(*) AS n_rows, sha256(string_agg(row, ',' ORDER BY row)) AS row_hash FROM r WHERE row IS NOT NULL GROUP BY ALL""",
    "finding_coverage": """WITH e AS (SELECT count(DISTINCT rule_id) AS n_expected FROM anomalies), s AS (SELECT project_id, count(DISTINCT rule_id) AS n FROM anomalies GROUP BY ALL)
        SELECT p.project_id, n_expected, coalesce(s.n, 0) AS n_seen, CASE WHEN coalesce(s.n, 0) = 0 THEN 'none' WHEN s.n < n_expected THEN 'partial' ELSE 'complete' END AS coverage
        FROM (SELECT DISTINCT project_id FROM settlement_periods) p LEFT JOIN s USING (project_id), e""",
    "severity_maximum": """SELECT project_id, subject_type, arg_max(severity, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS worst, count(*) AS n FROM anomalies GROUP BY ALL""",
    "pair_metrics": """WITH p AS (SELECT p_name || '|' || p_type AS a, p_name || '|' || p_brand AS b FROM part),
        n AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM p GROUP BY a, b)) AS tp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM p GROUP BY a)) AS p,
              (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM p GROUP BY b)) AS t, (SELECT count(*) * (count(*) - 1) / 2 FROM p) AS al)
        SELECT CAST(tp AS BIGINT) AS tp, CAST(p - tp AS BIGINT) AS fp, CAST(t - tp AS BIGINT) AS fn, CAST(al - t - p + tp AS BIGINT) AS tn, round(tp / p, 4) AS precision, round(tp / t, 4) AS recall,
        round(2 * (tp / p) * (tp / t) / ((tp / p) + (tp / t)), 4) AS f1, round((p - tp) / (al - t), 4) AS fpr FROM n""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
