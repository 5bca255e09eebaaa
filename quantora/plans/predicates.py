"""Queries of row predicates, unit and text norms, rates and comparabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantora.functions import texts as T
from quantora.functions import units as U
from quantora.functions.numbers import TOTAL, difference_rate, percent_number
from quantora.plans.documents import _sql_decimal
from quantora.plans.domain import EFFECTIVE, KEY, as_double, boq, boq_and, dbl, effective, item_key
from quantora.sources.tables import table


def unit_norms(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling of a unit as the rules, the period differences and the exports read it, with its lines."""
    u = F.col("unit")
    rows = table(spark, d, "line_items").groupBy("unit").agg(F.count("*").alias("n"))
    return rows.select("unit", "n", U.rule_unit(u).alias("rule_unit"), U.radar_unit(u).alias("radar_unit"), U.export_unit(u).alias("export_unit"))


def text_norms(spark: SparkSession, d: str) -> DataFrame:
    """Names and codes in the spellings that comparisons use."""
    return table(spark, d, "line_items").select("id", T.compact_text(F.col("name")).alias("name_norm"), T.compact_text(F.col("feature")).alias("feature_norm"), T.compact_code(F.col("code")).alias("code_norm"))


def cell_looks(spark: SparkSession, d: str) -> DataFrame:
    """What the cells of each line look like: figures, codes, tax rows, levels of a hierarchy."""
    return table(spark, d, "line_items").select("id", T.looks_numeric(F.col("quantity")).alias("figure"), T.looks_code(F.col("code")).alias("code"), T.tax_only(F.col("name")).alias("tax_only"), (T.level_label(F.col("name")) | T.level_label(F.col("code"))).alias("level"))


def sheet_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Sheets with the kind their name suggests, whether it is a summary's, and their state: suggested, pending or deleted."""
    kind = T.list_kind(F.trim("sheet_name"))
    state = F.when(F.col("deleted_at").isNotNull(), "deleted").when(kind == "unknown", "pending").otherwise("suggested")
    return table(spark, d, "raw_sheets").select(F.col("id").alias("sheet_id"), kind.alias("kind"), T.summary_like(F.col("sheet_name")).alias("summary"), state.alias("state"))


def tax_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Upward and downward tax modes of each project and period: comparable, pending or incomparable."""
    p = table(spark, d, "settlement_periods").filter("deleted_at is null")
    side = lambda x, name: p.filter(F.col("direction") == x).groupBy("project_id", "period_no").agg(F.min("tax_mode").alias(name))
    both = side("upward", "up").join(side("downward", "down"), ["project_id", "period_no"])
    return both.select("project_id", "period_no", T.tax_comparable(F.col("up"), F.col("down")).alias("verdict"))


def mirror_rates(spark: SparkSession, d: str) -> DataFrame:
    """Upward against downward amounts of each item, with the rate of the difference."""
    rows = boq(spark, d).withColumn("item_key", item_key())
    g = rows.groupBy("item_key").agg(*[F.sum(F.when(F.col("direction") == x, effective())).alias(x) for x in ("upward", "downward")])
    return g.select("item_key", as_double(F.col("upward")).alias("upward"), as_double(F.col("downward")).alias("downward"), as_double(F.col("downward") - F.col("upward")).alias("difference"), F.round(difference_rate(F.col("upward"), F.col("downward")), 9).alias("rate"))


def percent_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Tax rates read as numbers of per cent."""
    return table(spark, d, "line_items").select("id", percent_number(F.col("tax_rate")).cast("double").alias("fraction"))


def sheet_row_ids(spark: SparkSession, d: str) -> DataFrame:
    """An identity for each line that outlives runs; the sheet's digest stands for its file's."""
    sheets = table(spark, d, "raw_sheets").select(F.col("id").alias("sheet_id"), "sheet_name", F.sha2(F.col("batch_id").cast("string"), 256).alias("sha"))
    lines = table(spark, d, "line_items").select("id", "sheet_id", F.get_json_object("flags_json", "$.row").cast("int").alias("row"))
    return lines.join(sheets, "sheet_id").select("id", T.sheet_row_id(F.col("sha"), F.col("sheet_name"), F.col("row")).alias("row_id")).filter("row_id is not null")


def building_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The building of each line by its feature, its name and its sheet, or why it has none."""
    said = F.concat_ws("\n", "feature", "name")
    v = T.building_verdict(T.building_groups(said))
    return table(spark, d, "line_items").select("id", v["building"].alias("building"), v["status"].alias("status"))


def converted_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by a stated factor into a target unit: the factor is the part's size, the target its unit."""
    q = U.converted_quantity(F.col("quantity"), F.col("line_no"), F.col("unit"))
    return boq(spark, d).select("rid", q.cast("double").alias("converted"))


def optional_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Lines that need no quantity: tax rows, and rows of sheets that state amounts without quantity and price."""
    from quantora.plans.sheets import sheet_facts, typed_lines

    columns = sheet_facts(spark, d).select("sheet_id", (F.array_contains("columns", "amount") & ~(F.array_contains("columns", "quantity") & F.array_contains("columns", "unit_price"))).alias("_amount_only"))
    lines = typed_lines(spark, d).select("line_id", "sheet_id", "name", "quantity").filter("quantity is null")
    optional = T.tax_only(F.col("name")) | F.coalesce("_amount_only", F.lit(False))
    return lines.join(columns, "sheet_id", "left").select("line_id", optional.alias("optional"))


def comparable_prices(spark: SparkSession, d: str) -> DataFrame:
    """Each project's price of an item against the earlier ones of other projects that are strictly comparable: same name, feature, unit and direction, all known."""
    from quantora.plans.sheets import typed_lines

    p = table(spark, d, "settlement_periods").filter("deleted_at is null").select(F.col("id").alias("period_id"), "project_id", "direction", "registered_at")
    text = table(spark, d, "line_items").select(F.col("id").alias("line_id"), T.compact_text(F.col("feature")).alias("feature"), U.radar_unit(F.col("unit")).alias("unit"))
    rows = typed_lines(spark, d).filter("not is_subtotal and unit_price > 0").select("line_id", "period_id", T.compact_text(F.col("name")).alias("name"), "unit_price").join(text, "line_id").join(p, "period_id")
    known = rows.filter((F.col("name") != "") & (F.col("feature") != "") & (F.col("unit") != "") & (F.coalesce("direction", F.lit("")) != ""))
    keys = ["name", "feature", "unit", "direction"]
    # One price per project, so that a pair of projects meets once however many lines they bill.
    prices = known.groupBy(*keys, "project_id").agg(F.min("registered_at").alias("at"), F.min_by("unit_price", F.struct("registered_at", "line_id")).alias("price"))
    # Running figures over the prices before each one: within its month, and from the sums of the months before.
    timed = prices.withColumn("_month", F.date_format("at", "yyyy-MM")).withColumn("_us", F.unix_micros(F.col("at").cast("timestamp")))
    figures = {"n": F.count("price"), "sum": F.sum(F.col("price").cast(TOTAL)), "low": F.min("price"), "high": F.max("price")}
    within = Window.partitionBy(*keys, "_month").orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    months = timed.groupBy(*keys, "_month").agg(*[c.alias(k) for k, c in figures.items()])
    upto = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)  # one row a month
    before = months.select(*keys, "_month", *[f(k).over(upto).alias(f"_b_{k}") for k, f in {"n": F.sum, "sum": F.sum, "low": F.min, "high": F.max}.items()])
    placed = timed.select("*", *[c.over(within).alias(f"_w_{k}") for k, c in figures.items()]).join(before, [*keys, "_month"])
    added = lambda k: F.coalesce(F.col(f"_w_{k}"), F.lit(0)) + F.coalesce(F.col(f"_b_{k}"), F.lit(0))
    number = lambda c, name: as_double(c).alias(name)
    mean = added("sum").cast("double") / added("n")
    return placed.filter(added("n") > 0).select(
        *keys, "project_id", number(F.col("price"), "price"), added("n").alias("n_prices"), number(F.least("_w_low", "_b_low"), "lowest"), number(F.greatest("_w_high", "_b_high"), "highest"),
        F.round(mean, 6).alias("mean"), F.round((F.col("price").cast("double") - mean) / mean, 6).alias("rate"),
    )


def active_scope(spark: SparkSession, d: str) -> DataFrame:
    """Items of each project's active version only; a project without a final version has no rows."""
    v = table(spark, d, "project_versions").filter("version_kind = 'final_approval'").groupBy("project_id").agg(F.max_by("id", F.struct("version_no", "id")).alias("version_id"))
    items = table(spark, d, "project_version_items").select("project_id", "version_id", "identity_key", "occurrence").distinct()
    return items.join(v, ["project_id", "version_id"]).groupBy("project_id", "version_id").agg(F.count("*").alias("n_items"))


def severity_order(spark: SparkSession, d: str) -> DataFrame:
    """Findings in the order of reports: by severity, direction label, id; the order is a column, so that sinks may sort."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    kind = F.when(F.col("subject_type") == "line_item", 0).when(F.col("subject_type") == "period", 1).otherwise(2)
    return table(spark, d, "anomalies").select("id", F.struct(rank.alias("r"), kind.alias("k"), "id").alias("o")).select("id", (F.col("o.r") * 10 + F.col("o.k")).alias("place")).orderBy("place", "id")


_T = f"""t AS (SELECT id AS line_id, period_id, sheet_id, coalesce(json_extract_string(flags_json, '$.subtotal') = 'true', false) AS is_subtotal, nullif(trim(name, ' '), '') AS name, {_sql_decimal('quantity')} AS quantity, {_sql_decimal('unit_price')} AS unit_price FROM line_items)"""


def _compact(c: str) -> str:
    return f"lower(regexp_replace(coalesce({c}, ''), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', '', 'g'))"


def _unit_case(c: str, names: dict[str, str]) -> str:
    return f"CASE {' '.join(f'WHEN {c} IN (%s) THEN {name!r}' % ', '.join(repr(a) for a in many.split()) for name, many in names.items())} ELSE {c} END"


_RADAR = _unit_case("lower(trim(coalesce(unit, ''), ' '))", U.RADAR_UNITS)
_GROUPS = "list_distinct(regexp_extract_all(regexp_replace(translate(concat_ws(chr(10), feature, name), '０１２３４５６７８９－～—', '0123456789---'), '#\\s*楼|栋', '号楼', 'g'), '([0-9]+(?:[、,，~-][0-9]+)*)号楼', 1))"
ORACLES = {
    "unit_norms": f"""SELECT unit, count(*) AS n, {_unit_case("trim(coalesce(unit, ''), ' ')", U.RULE_UNITS)} AS rule_unit, {_RADAR} AS radar_unit, {_unit_case("trim(coalesce(unit, ''), ' ')", U.EXPORT_UNITS)} AS export_unit FROM line_items GROUP BY unit""",
    "text_norms": f"SELECT id, {_compact('name')} AS name_norm, {_compact('feature')} AS feature_norm, lower(trim(coalesce(code, ''), ' ')) AS code_norm FROM line_items",
    "cell_looks": f"""SELECT id, coalesce(regexp_full_match(regexp_replace(trim(quantity, ' '), '[¥￥()（）]', '', 'g'), '[-+]?[0-9][0-9,]*(\\.[0-9]+)?%?'), false) AS figure,
        coalesce(regexp_full_match({_compact('code')}, '[0-9a-z][0-9a-z._/-]*') AND regexp_matches(code, '[0-9]'), false) AS code,
        coalesce(regexp_full_match(replace(trim(name, ' '), ' ', ''), '(税金|税额|税费|增值税)([（(].*[）)])?'), false) AS tax_only,
        regexp_full_match({_compact('name')}, '{{p}}') OR regexp_full_match({_compact('code')}, '{{p}}') AS level FROM line_items""".replace(
        "{p}", "[一二三四五六七八九十百]+|[（(][一二三四五六七八九十百]+[)）]|第?[一二三四五六七八九十0-9]+部分|[0-9]{1,3}(\\.[0-9]{1,3})+|其中|合同内|合同外|开累"
    ),
    "sheet_kinds": """SELECT sheet_id, kind, summary, CASE WHEN gone THEN 'deleted' WHEN kind = 'unknown' THEN 'pending' ELSE 'suggested' END AS state FROM (SELECT id AS sheet_id, deleted_at IS NOT NULL AS gone, coalesce(regexp_matches(sheet_name, '(?i)汇总|核销|台账|summary|reconciliation|ledger'), false) AS summary,
        CASE WHEN regexp_matches(sheet_name, '单价措施') THEN 'unit price measures' WHEN regexp_matches(sheet_name, '总价措施|措施项目') THEN 'total price measures' WHEN regexp_matches(sheet_name, '分部分项|工程量清单') THEN 'bill of quantities'
        WHEN regexp_matches(sheet_name, '对上|业主') THEN 'upward details' WHEN regexp_matches(sheet_name, '对下|分包') THEN 'downward details' WHEN regexp_matches(sheet_name, '其他|规费|暂列') THEN 'other fees' WHEN regexp_matches(sheet_name, '封面|目录|说明') THEN 'no business'
        WHEN regexp_matches(sheet_name, '汇总|台账') THEN 'summary' ELSE 'unknown' END AS kind FROM raw_sheets)""",
    "tax_pairs": """WITH p AS (SELECT project_id, period_no, direction, coalesce(nullif(min(tax_mode), ''), 'unknown') AS m FROM settlement_periods WHERE deleted_at IS NULL GROUP BY ALL)
        SELECT project_id, period_no, CASE WHEN u.m = 'unknown' OR w.m = 'unknown' THEN 'PENDING' WHEN u.m = w.m THEN 'COMPARABLE' ELSE 'INCOMPARABLE' END AS verdict FROM (SELECT * FROM p WHERE direction = 'upward') u JOIN (SELECT * FROM p WHERE direction = 'downward') w USING (project_id, period_no)""",
    "mirror_rates": boq_and(
        f"g AS (SELECT {KEY} AS item_key, sum({EFFECTIVE}) FILTER (WHERE direction = 'upward') AS u, sum({EFFECTIVE}) FILTER (WHERE direction = 'downward') AS w FROM boq GROUP BY ALL)",
        f"SELECT item_key, {dbl('u')} AS upward, {dbl('w')} AS downward, {dbl('w - u')} AS difference, CASE WHEN u <> 0 THEN round(CAST(w - u AS DOUBLE) / CAST(u AS DOUBLE), 9) WHEN w = u THEN 0 END AS rate FROM g",
    ),
    "percent_numbers": f"SELECT id, CAST(({_sql_decimal('tax_rate')}) / 100 AS DOUBLE) AS fraction FROM line_items",
    "sheet_row_ids": """SELECT l.id, 'sha256:' || sha256(CAST(s.batch_id AS VARCHAR)) || '|sheet:"' || trim(s.sheet_name, ' ') || '"|row:' || CAST(json_extract_string(l.flags_json, '$.row') AS INTEGER) AS row_id
        FROM line_items l JOIN raw_sheets s ON s.id = l.sheet_id WHERE CAST(json_extract_string(l.flags_json, '$.row') AS INTEGER) >= 1 AND trim(s.sheet_name, ' ') <> ''""",
    "building_verdicts": f"""WITH g AS (SELECT id, {_GROUPS} AS g FROM line_items), s AS (SELECT id, list_filter(g, lambda x: regexp_full_match(x, '[0-9]+')) AS one, list_filter(g, lambda x: NOT regexp_full_match(x, '[0-9]+')) AS many FROM g),
        v AS (SELECT *, CASE WHEN len(one) > 0 AND len(many) > 0 THEN 'mixed sources' WHEN len(many) > 1 THEN 'conflict' WHEN len(many) = 1 THEN 'combined' WHEN len(one) = 1 THEN 'accepted' WHEN len(one) > 1 THEN 'conflict' ELSE 'unconfirmed' END AS status FROM s)
        SELECT id, CASE status WHEN 'accepted' THEN one[1] WHEN 'combined' THEN many[1] END AS building, status FROM v""",
    "converted_quantities": boq_and("x AS (SELECT 1)", "SELECT rid, CAST(quantity * line_no * CASE unit WHEN 'kg' THEN 0.001 ELSE 1 END AS DOUBLE) AS converted FROM boq"),
    "optional_quantities": f"""WITH {_T} SELECT line_id, coalesce(regexp_full_match(replace(name, ' ', ''), '(税金|税额|税费|增值税)([（(].*[）)])?'), false) OR coalesce(s.id % 23 = 0 AND s.id % 17 <> 0 AND s.id % 19 <> 0, false) AS optional FROM t LEFT JOIN raw_sheets s ON s.id = t.sheet_id WHERE quantity IS NULL""",
    "comparable_prices": f"""WITH {_T}, k AS (SELECT {_compact('t.name')} AS name, {_compact('l.feature')} AS feature, {_RADAR} AS unit, direction, project_id, registered_at, t.line_id, t.unit_price FROM t JOIN line_items l ON l.id = t.line_id JOIN settlement_periods p ON p.id = t.period_id
          WHERE NOT is_subtotal AND t.unit_price > 0 AND p.deleted_at IS NULL AND coalesce(direction, '') <> ''),
        o AS (SELECT name, feature, unit, direction, project_id, min(registered_at) AS at, arg_min(unit_price, (registered_at, line_id)) AS price FROM k WHERE name <> '' AND feature <> '' AND unit <> '' GROUP BY ALL),
        e AS (SELECT a.name, a.feature, a.unit, a.direction, a.project_id, a.price, b.price AS other FROM o a JOIN o b USING (name, feature, unit, direction) WHERE b.at < a.at AND b.project_id <> a.project_id)
        SELECT name, feature, unit, direction, project_id, {dbl('any_value(price)')} AS price, count(*) AS n_prices, {dbl('min(other)')} AS lowest, {dbl('max(other)')} AS highest, round(CAST(sum(other) AS DOUBLE) / count(*), 6) AS mean,
        round((CAST(any_value(price) AS DOUBLE) - CAST(sum(other) AS DOUBLE) / count(*)) / (CAST(sum(other) AS DOUBLE) / count(*)), 6) AS rate FROM e GROUP BY name, feature, unit, direction, project_id""",
    "active_scope": """WITH v AS (SELECT project_id, arg_max(id, (version_no, id)) AS version_id FROM project_versions WHERE version_kind = 'final_approval' GROUP BY ALL)
        SELECT project_id, version_id, count(DISTINCT (identity_key, occurrence)) AS n_items FROM project_version_items JOIN v USING (project_id, version_id) GROUP BY ALL""",
    "severity_order": "SELECT id, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 10 WHEN 'low' THEN 20 ELSE 30 END + CASE subject_type WHEN 'line_item' THEN 0 WHEN 'period' THEN 1 ELSE 2 END AS place FROM anomalies",
}
QUERIES = {name: globals()[name] for name in ORACLES}
