"""Join queries: provenance, polymorphic, anti, semi, one-to-one, progressive, positional, range, alias, array, mirror."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantora.functions.numbers import TOTAL
from quantora.operators import pairing
from quantora.plans.domain import EFFECTIVE, KEY, as_double, boq, boq_and, dbl, effective, item_key, over_boq
from quantora.plans.sheets import SHEET_FACTS
from quantora.sources.tables import table


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Each line with its period and sheet, where they exist."""
    periods = table(spark, d, "settlement_periods").select(F.col("id").alias("period_id"), "project_id", "direction", "period_no")
    sheets = table(spark, d, "raw_sheets").select(F.col("id").alias("sheet_id"), "batch_id", "sheet_name")
    lines = table(spark, d, "line_items").select("id", "period_id", "sheet_id")
    return lines.join(periods, "period_id", "left").join(sheets, "sheet_id", "left").select("id", "project_id", "direction", "period_no", "batch_id", "sheet_name")


def updown_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Upward and downward totals of each item side by side; a difference only where both sides have one."""
    rows = boq(spark, d).withColumn("item_key", item_key()).filter(~F.col("is_deduction"))
    one = lambda side: rows.filter(F.col("direction") == side).groupBy("item_key").agg(F.sum(effective()).alias(side))
    joined = one("upward").withColumn("_u", F.lit(1)).join(one("downward").withColumn("_d", F.lit(1)), "item_key", "full")
    status = F.when(F.col("_u").isNull(), "only downward").when(F.col("_d").isNull(), "only upward").otherwise("both")
    return joined.select("item_key", as_double(F.col("upward")).alias("upward"), as_double(F.col("downward")).alias("downward"), as_double(F.col("upward") - F.col("downward")).alias("difference"), status.alias("status"))


def finding_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Each finding with a label of the line, period or sheet it is about: three keyed left joins."""
    a = table(spark, d, "anomalies").select("id", "subject_type", "subject_id")
    side = lambda name, kind, label: table(spark, d, name).select(F.lit(kind).alias("subject_type"), F.col("id").alias("subject_id"), label.alias(f"_{kind}"))
    joined = (
        a.join(side("line_items", "line_item", F.col("name")), ["subject_type", "subject_id"], "left")
        .join(side("settlement_periods", "period", F.col("title")), ["subject_type", "subject_id"], "left")
        .join(side("raw_sheets", "sheet", F.col("sheet_name")), ["subject_type", "subject_id"], "left")
    )
    return joined.select("id", "subject_type", F.coalesce("_line_item", "_period", "_sheet").alias("subject"))


def unbilled_periods(spark: SparkSession, d: str) -> DataFrame:
    """Periods without any line, counted per project and direction (anti join)."""
    periods = table(spark, d, "settlement_periods").select(F.col("id").alias("period_id"), "project_id", "direction")
    return periods.join(table(spark, d, "line_items").select("period_id"), "period_id", "left_anti").groupBy("project_id", "direction").agg(F.count("*").alias("n_periods"))


def customers_with_orders(spark: SparkSession, d: str) -> DataFrame:
    """Customers with at least one urgent order (semi join)."""
    urgent = table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


def _pair_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All pairs of successive periods of a direction at once: each row as the earlier and as the later side.

    ``pair`` names the direction and the earlier period; ``id`` is the row within it.
    """
    rows = boq(spark, d)
    side = lambda shift: rows.withColumn("pair", F.concat_ws(":", "direction", F.col("period_no") - shift)).withColumn("id", F.concat_ws("@", "rid", "pair"))
    return side(0), side(1)


def unique_key_classes(spark: SparkSession, d: str) -> DataFrame:
    """How the rows of successive periods classify by code and unit: null, duplicate, blocked, only or matched."""
    return pairing.classify_keys(*_pair_sides(spark, d), ["pair", "code", "unit"], "id", "id")


def three_pass_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of successive periods paired by code, then name, feature and unit, then name and feature; only what is unique."""
    passes = [("code", ("code",)), ("text_unit", ("name", "feature", "unit")), ("text", ("name", "feature"))]
    return pairing.progressive_pairs(*_pair_sides(spark, d), [(name, pairing.composite_key("pair", *fields)) for name, fields in passes])


def positional_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of successive periods paired by position within their code; repeated codes are ambiguous."""
    left, right = (s.filter("code <> ''").select("id", "pair", "code") for s in _pair_sides(spark, d))
    return pairing.positional_pairs(left, right, ["pair", "code"], "id").withColumn("position", F.col("position").cast("int"))


def latest_batch_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The sheets of the latest batch of each sheet name and index."""
    w = Window.partitionBy("sheet_name", "sheet_index").orderBy(F.desc("loaded_at"), F.desc("id"))
    rows = table(spark, d, "raw_sheets").withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return rows.select("sheet_name", "sheet_index", "id", "batch_id")


def lines_in_row_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Lines per sheet and band of twenty rows, by an equi join with the bands of the same sheet."""
    sheets = table(spark, d, "raw_sheets").filter("n_rows > 0").select(F.col("id").alias("sheet_id"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n_rows") - 1) / 20).cast("int"))).alias("band"))
    bands = sheets.select("sheet_id", "band", (F.col("band") * 20 + 1).alias("_low"), (F.col("band") * 20 + 20).alias("_high"))
    lines = table(spark, d, "line_items").select("sheet_id", F.get_json_object("flags_json", "$.row").cast("int").alias("row")).filter("row is not null").withColumn("band", F.floor((F.col("row") - 1) / 20).cast("int"))
    hit = lines.join(bands, ["sheet_id", "band"]).filter(F.col("row").between(F.col("_low"), F.col("_high")))
    return hit.groupBy("sheet_id", "band").agg(F.count("*").alias("n_lines"))


def alias_units(spark: SparkSession, d: str) -> DataFrame:
    """Lines counted by unit after an alias lookup; unknown units stay themselves."""
    pairs = [("平方米", "m2"), ("平米", "m2"), ("㎡", "m2"), ("m²", "m2"), ("立方米", "m3"), ("㎥", "m3"), ("m³", "m3"), ("吨", "t"), ("米", "m")]
    aliases = F.broadcast(spark.createDataFrame(pairs, "unit string, standard string"))  # a fixed list
    lines = table(spark, d, "line_items").select(F.trim("unit").alias("unit")).filter("unit is not null and unit <> ''")
    joined = lines.join(aliases, "unit", "left").select(F.coalesce("standard", "unit").alias("unit"))
    return joined.groupBy("unit").agg(F.count("*").alias("n"))


def may_match(spark: SparkSession, d: str) -> DataFrame:
    """Version items that may be a line of the same project: by code, or by name and unit; a union of equi joins, each pair once."""
    periods = table(spark, d, "settlement_periods").select(F.col("id").alias("period_id"), "project_id")
    lines = table(spark, d, "line_items").select("period_id", "code", "name", "unit").join(periods, "period_id")
    codes = lines.filter("code <> ''").select("project_id", "code").distinct()
    texts = lines.select("project_id", "name", "unit").filter("name <> '' and unit <> ''").distinct()
    items = table(spark, d, "project_version_items").select("id", "project_id", "code", "name", "unit")
    by_code = items.filter("code <> ''").join(codes, ["project_id", "code"]).select("id", F.lit("code").alias("by"))
    by_text = items.join(texts, ["project_id", "name", "unit"]).select("id", F.lit("text").alias("by"))
    return by_code.unionByName(by_text).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("by")), "+").alias("matched_by"))


def evidence_members(spark: SparkSession, d: str) -> DataFrame:
    """The lines that each evidence names in its list of sources, with whether they exist."""
    members = table(spark, d, "evidence").select(F.col("id").alias("evidence_id"), F.explode(F.from_json("sources_json", "array<struct<line_item_id:bigint>>")).alias("s"))
    members = members.select("evidence_id", F.col("s.line_item_id").alias("line_item_id")).filter("line_item_id is not null")
    lines = table(spark, d, "line_items").select(F.col("id").alias("line_item_id"), F.lit(True).alias("_here"))
    return members.join(lines, "line_item_id", "left").select("evidence_id", "line_item_id", F.coalesce("_here", F.lit(False)).alias("found"))


MIRROR_TEXTS, MIRROR_FIGURES = ("name", "feature", "unit", "tax_rate"), ("quantity", "unit_price", "amount")


def mirror_compare(spark: SparkSession, d: str) -> DataFrame:
    """Both directions of a code field by field: status, difference and rate of seven fields; one pass, no join.

    A side's text, or unit price, is its one value; quantities and amounts are summed
    and the unit price is derived from both where all rows have them. Status by
    precedence: several values, missing, incomparable (figures of other units or
    features), differs, equal.
    """
    from quantora.functions.numbers import difference_rate

    rows = boq(spark, d).filter("code <> ''")
    aggregates = []
    for s in ("upward", "downward"):
        own = lambda c, s=s: F.when(F.col("direction") == s, F.col(c))
        aggregates += [x.alias(f"{s}_{c}_{k}") for c in (*MIRROR_TEXTS, "unit_price") for k, x in (("low", F.min(own(c))), ("high", F.max(own(c))))]
        aggregates += [F.when(F.count_if((F.col("direction") == s) & F.col(c).isNull()) == 0, F.sum(own(c).cast("decimal(38,6)"))).alias(f"{s}_{c}_sum") for c in ("quantity", "amount")]
    g = rows.groupBy("code").agg(*aggregates)
    value = lambda s, c: F.col(f"{s}_{c}_sum" if c in ("quantity", "amount") else f"{s}_{c}_low")
    several = lambda s, c: F.lit(False) if c in ("quantity", "amount") else F.coalesce(F.col(f"{s}_{c}_low") != F.col(f"{s}_{c}_high"), F.lit(False))
    mixed = several("upward", "unit") | several("downward", "unit") | (value("upward", "unit") != value("downward", "unit")) | (value("upward", "feature") != value("downward", "feature"))
    parts = []
    for c in (*MIRROR_TEXTS, *MIRROR_FIGURES):
        u, w, figure = value("upward", c), value("downward", c), c in MIRROR_FIGURES
        status = F.when(several("upward", c) | several("downward", c), "several values").when(u.isNull() | w.isNull(), "missing")
        if figure:
            status = status.when(F.coalesce(mixed, F.lit(False)), "incomparable")
        status = status.when(u == w, "equal").otherwise("differs")
        told = status.isin("equal", "differs")
        parts.append(F.struct(F.lit(c).alias("field"), status.alias("status"), F.when(told, (w - u).cast("double")).cast("double").alias("difference") if figure else F.lit(None).cast("double").alias("difference"), F.when(told, difference_rate(u, w)).alias("rate") if figure else F.lit(None).cast("double").alias("rate")))
    return g.select("code", F.explode(F.array(*parts)).alias("f")).select("code", "f.field", "f.status", F.round("f.difference", 4).alias("difference"), F.round("f.rate", 9).alias("rate"))


def membership_compare(spark: SparkSession, d: str) -> DataFrame:
    """Per sheet, whether the row numbers of its lines are exactly the expected 2..n: counts of missing and extra rows."""
    lines = table(spark, d, "line_items").select("sheet_id", F.get_json_object("flags_json", "$.row").cast("int").alias("row")).filter("sheet_id is not null and row is not null").distinct()
    expected = lines.groupBy("sheet_id").agg(F.max("row").alias("_m")).select("sheet_id", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), "_m"))).alias("row"), F.lit(1).alias("_e"))
    joined = lines.withColumn("_a", F.lit(1)).join(expected, ["sheet_id", "row"], "full")
    return joined.groupBy("sheet_id").agg(F.count_if(F.col("_a").isNull()).alias("n_absent"), F.count_if(F.col("_e").isNull()).alias("n_extra"))


def latest_rule_status(spark: SparkSession, d: str) -> DataFrame:
    """The newest status of each project and rule, for every rule of the catalogue; rules never seen are open."""
    a = table(spark, d, "anomalies").select("project_id", "rule_id", "status", F.struct("created_at", "id").alias("_o"))
    newest = a.groupBy("project_id", "rule_id").agg(F.max_by("status", "_o").alias("status"))
    rules = a.select("rule_id").distinct()
    wanted = newest.groupBy("project_id").agg(F.collect_set("rule_id").alias("_have")).select("project_id", "_have")
    catalogue = rules.agg(F.array_sort(F.collect_set("rule_id")).alias("_all"))
    missing = wanted.join(F.broadcast(catalogue)).select("project_id", F.explode(F.array_except("_all", "_have")).alias("rule_id"), F.lit("open").alias("status"))  # one row on the right
    return newest.unionByName(missing)


def header_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Multiset similarity of part names by words: the size of the intersection over that of the union, against one template."""
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).groupBy("p_partkey", "w").agg(F.count("*").alias("n"))
    template = words.filter("p_partkey = 1").select("w", F.col("n").alias("m"))
    names = words.select("p_partkey").distinct()
    joined = words.join(F.broadcast(template), "w", "left")
    size = template.agg(F.sum("m").alias("_t"))
    per = joined.groupBy("p_partkey").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("_i"), F.sum("n").alias("_n"))
    return names.join(per, "p_partkey").join(F.broadcast(size)).select("p_partkey", F.round(F.col("_i") / (F.col("_n") + F.col("_t") - F.col("_i")), 4).alias("similarity"))


# The kept mapping templates of the recommendation query.
TEMPLATES = {1: ("code", "name", "unit", "quantity", "unit_price", "amount"), 2: ("code", "name", "unit", "quantity"), 3: ("name", "unit", "amount"), 4: ("name", "unit", "quantity", "unit_price", "amount"), 5: ("tax", "fee")}


def template_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """The three templates that each sheet's header resembles most (a top-k report)."""
    from quantora.operators.grid import recommend_templates
    from quantora.plans.sheets import sheet_facts

    sheets = sheet_facts(spark, d).select("sheet_id", F.col("columns").alias("labels"), F.col("columns").alias("fields"))
    templates = spark.createDataFrame([(i, list(t), list(t)) for i, t in TEMPLATES.items()], "template_id int, labels array<string>, fields array<string>")
    return recommend_templates(sheets, templates, limit=3)


def table_sets(spark: SparkSession, d: str) -> DataFrame:
    """Codes of lines and of version items: in both, in one only; union, intersection and difference in one pass."""
    side = lambda name, s: table(spark, d, name).select(F.trim("code").alias("code"), F.lit(s).alias("s")).filter("code <> ''").distinct()
    both = side("line_items", 1).unionByName(side("project_version_items", 2)).groupBy("code").agg(F.sum("s").alias("s"))
    return both.groupBy(F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "lines only").otherwise("versions only").alias("membership")).agg(F.count("*").alias("n"))


_SIDES = ", ".join(
    f"{s} AS (SELECT *, direction || ':' || (period_no - {n}) AS pair, rid || '@' || direction || ':' || (period_no - {n}) AS id FROM boq)" for s, n in (("l", 0), ("r", 1))
)


def _pass(n: int, name: str, key: str, present: str) -> str:
    return f""", p{n} AS (SELECT a.id AS left_id, b.id AS right_id, '{name}' AS pass FROM (SELECT {key} AS k, min(id) AS id FROM l{n} WHERE {present} GROUP BY 1 HAVING count(*) = 1) a
        JOIN (SELECT {key} AS k, min(id) AS id FROM r{n} WHERE {present} GROUP BY 1 HAVING count(*) = 1) b USING (k)),
        l{n + 1} AS (SELECT * FROM l{n} WHERE id NOT IN (SELECT left_id FROM p{n})), r{n + 1} AS (SELECT * FROM r{n} WHERE id NOT IN (SELECT right_id FROM p{n}))"""


_ROW = "CAST(json_extract_string(flags_json, '$.row') AS INTEGER)"
ORACLES = {
    "provenance": "SELECT l.id, p.project_id, p.direction, p.period_no, s.batch_id, s.sheet_name FROM line_items l LEFT JOIN settlement_periods p ON p.id = l.period_id LEFT JOIN raw_sheets s ON s.id = l.sheet_id",
    "updown_full_outer": boq_and(
        f"k AS (SELECT {KEY} AS item_key, direction, sum({EFFECTIVE}) AS t FROM boq WHERE NOT is_deduction GROUP BY ALL)",
        f"""SELECT item_key, {dbl('u.t')} AS upward, {dbl('w.t')} AS downward, {dbl('u.t - w.t')} AS difference, CASE WHEN u.direction IS NULL THEN 'only downward' WHEN w.direction IS NULL THEN 'only upward' ELSE 'both' END AS status
        FROM (SELECT * FROM k WHERE direction = 'upward') u FULL JOIN (SELECT * FROM k WHERE direction = 'downward') w USING (item_key)""",
    ),
    "finding_subjects": """SELECT a.id, a.subject_type, coalesce(l.name, p.title, s.sheet_name) AS subject FROM anomalies a LEFT JOIN line_items l ON a.subject_type = 'line_item' AND l.id = a.subject_id
        LEFT JOIN settlement_periods p ON a.subject_type = 'period' AND p.id = a.subject_id LEFT JOIN raw_sheets s ON a.subject_type = 'sheet' AND s.id = a.subject_id""",
    "unbilled_periods": "SELECT project_id, direction, count(*) AS n_periods FROM settlement_periods p WHERE NOT EXISTS (SELECT 1 FROM line_items l WHERE l.period_id = p.id) GROUP BY ALL",
    "customers_with_orders": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND starts_with(o_orderpriority, '1'))",
    "unique_key_classes": boq_and(
        _SIDES + """, b AS (SELECT 'left' AS side, id, CASE WHEN code <> '' THEN pair || '|' || code || '|' || unit END AS k FROM l UNION ALL SELECT 'right', id, CASE WHEN code <> '' THEN pair || '|' || code || '|' || unit END FROM r),
        c AS (SELECT k, count(*) FILTER (WHERE side = 'left') AS nl, count(*) FILTER (WHERE side = 'right') AS nr, min(id) FILTER (WHERE side = 'left') AS li, min(id) FILTER (WHERE side = 'right') AS ri FROM b WHERE k IS NOT NULL GROUP BY 1),
        d AS (SELECT side, id, CASE WHEN b.k IS NULL THEN 'null_key' WHEN (CASE side WHEN 'left' THEN nl ELSE nr END) > 1 THEN 'duplicate' WHEN (CASE side WHEN 'left' THEN nr ELSE nl END) > 1 THEN 'blocked'
          WHEN (CASE side WHEN 'left' THEN nr ELSE nl END) = 0 THEN 'only' ELSE 'matched' END AS class, CASE side WHEN 'left' THEN ri ELSE li END AS other FROM b LEFT JOIN c USING (k))""",
        "SELECT side, id, class, CASE WHEN class = 'matched' THEN other END AS partner FROM d",
    ),
    "three_pass_pairs": boq_and(
        _SIDES + ", l1 AS (SELECT * FROM l), r1 AS (SELECT * FROM r)" + _pass(1, "code", "pair || '|' || code", "code <> ''") + _pass(2, "text_unit", "pair || '|' || name || '|' || feature || '|' || unit", "true") + _pass(3, "text", "pair || '|' || name || '|' || feature", "true"),
        "SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3",
    ),
    "positional_pairs": boq_and(
        _SIDES + """, a AS (SELECT pair, code, id AS left_id, row_number() OVER (PARTITION BY pair, code ORDER BY id) AS position, count(*) OVER (PARTITION BY pair, code) AS n FROM l WHERE code <> ''),
        b AS (SELECT pair, code, id AS right_id, row_number() OVER (PARTITION BY pair, code ORDER BY id) AS position, count(*) OVER (PARTITION BY pair, code) AS m FROM r WHERE code <> '')""",
        "SELECT pair, code, CAST(position AS INTEGER) AS position, left_id, right_id, coalesce(n, 0) > 1 OR coalesce(m, 0) > 1 AS ambiguous FROM a FULL JOIN b USING (pair, code, position)",
    ),
    "latest_batch_sheets": "SELECT sheet_name, sheet_index, id, batch_id FROM raw_sheets QUALIFY row_number() OVER (PARTITION BY sheet_name, sheet_index ORDER BY loaded_at DESC, id DESC) = 1",
    "lines_in_row_ranges": f"""SELECT s.id AS sheet_id, CAST(({_ROW} - 1) // 20 AS INTEGER) AS band, count(*) AS n_lines FROM line_items l JOIN raw_sheets s ON s.id = l.sheet_id
        WHERE s.n_rows > 0 AND {_ROW} IS NOT NULL AND ({_ROW} - 1) // 20 <= (s.n_rows - 1) // 20 GROUP BY ALL""",
    "alias_units": """SELECT CASE trim(unit, ' ') WHEN '平方米' THEN 'm2' WHEN '平米' THEN 'm2' WHEN '㎡' THEN 'm2' WHEN 'm²' THEN 'm2' WHEN '立方米' THEN 'm3' WHEN '㎥' THEN 'm3' WHEN 'm³' THEN 'm3' WHEN '吨' THEN 't' WHEN '米' THEN 'm'
        ELSE trim(unit, ' ') END AS unit, count(*) AS n FROM line_items WHERE trim(unit, ' ') <> '' GROUP BY 1""",
    "may_match": """WITH l AS (SELECT project_id, code, name, unit FROM line_items i JOIN settlement_periods p ON p.id = i.period_id),
        m AS (SELECT id, (code <> '' AND (project_id, code) IN (SELECT project_id, code FROM l WHERE code <> '')) AS c,
          (name <> '' AND unit <> '' AND (project_id, name, unit) IN (SELECT project_id, name, unit FROM l WHERE name <> '' AND unit <> '')) AS t FROM project_version_items)
        SELECT id, CASE WHEN c AND t THEN 'code+text' WHEN c THEN 'code' ELSE 'text' END AS matched_by FROM m WHERE c OR t""",
    "evidence_members": """WITH m AS (SELECT id AS evidence_id, CAST(json_extract_string(s, '$.line_item_id') AS BIGINT) AS line_item_id FROM (SELECT id, unnest(from_json(sources_json, '["JSON"]')) AS s FROM evidence))
        SELECT evidence_id, line_item_id, line_item_id IN (SELECT id FROM line_items) AS found FROM m WHERE line_item_id IS NOT NULL""",
    "mirror_compare": boq_and(
        "g AS (SELECT code, "
        + ", ".join(f"{f}({c}) FILTER (WHERE direction = '{d}') AS {d[0]}_{c}_{f}" for d in ("upward", "downward") for c in (*MIRROR_TEXTS, "unit_price") for f in ("min", "max"))
        + ", "
        + ", ".join(f"CASE WHEN count(*) FILTER (WHERE direction = '{d}' AND {c} IS NULL) = 0 THEN sum({c}) FILTER (WHERE direction = '{d}') END AS {d[0]}_{c}_min, CASE WHEN true THEN NULL END AS {d[0]}_{c}_max" for d in ("upward", "downward") for c in ("quantity", "amount"))
        + " FROM boq WHERE code <> '' GROUP BY code), m AS (SELECT *, coalesce(u_unit_min <> u_unit_max OR d_unit_min <> d_unit_max OR u_unit_min <> d_unit_min OR u_feature_min <> d_feature_min, false) AS mixed FROM g), f AS ("
        + " UNION ALL ".join(
            f"""SELECT code, '{c}' AS field, CASE WHEN coalesce(u_{c}_min <> u_{c}_max, false) OR coalesce(d_{c}_min <> d_{c}_max, false) THEN 'several values' WHEN u_{c}_min IS NULL OR d_{c}_min IS NULL THEN 'missing'
            {"WHEN mixed THEN 'incomparable'" if c in MIRROR_FIGURES else ''} WHEN u_{c}_min = d_{c}_min THEN 'equal' ELSE 'differs' END AS status, {f"CAST(u_{c}_min AS DECIMAL(38,6))" if c in MIRROR_FIGURES else 'CAST(NULL AS DECIMAL(38,6))'} AS u, {f"CAST(d_{c}_min AS DECIMAL(38,6))" if c in MIRROR_FIGURES else 'CAST(NULL AS DECIMAL(38,6))'} AS w FROM m"""
            for c in (*MIRROR_TEXTS, *MIRROR_FIGURES)
        )
        + ")",
        """SELECT code, field, status, CASE WHEN status IN ('equal', 'differs') THEN round(CAST(w - u AS DOUBLE), 4) END AS difference,
        CASE WHEN status IN ('equal', 'differs') THEN CASE WHEN u <> 0 THEN round(CAST(w - u AS DOUBLE) / CAST(u AS DOUBLE), 9) WHEN w = u THEN 0 END END AS rate FROM f""",
    ),
    "membership_compare": f"""WITH r AS (SELECT DISTINCT sheet_id, {_ROW} AS row FROM line_items WHERE sheet_id IS NOT NULL AND {_ROW} IS NOT NULL), e AS (SELECT sheet_id, unnest(generate_series(2, greatest(2, max(row)))) AS row FROM r GROUP BY sheet_id)
        SELECT coalesce(r.sheet_id, e.sheet_id) AS sheet_id, count(*) FILTER (WHERE r.row IS NULL) AS n_absent, count(*) FILTER (WHERE e.row IS NULL) AS n_extra FROM r FULL JOIN e ON r.sheet_id = e.sheet_id AND r.row = e.row GROUP BY 1""",
    "latest_rule_status": """WITH n AS (SELECT project_id, rule_id, arg_max(status, (created_at, id)) AS status FROM anomalies GROUP BY ALL)
        SELECT p.project_id, r.rule_id, coalesce(n.status, 'open') AS status FROM (SELECT DISTINCT project_id FROM anomalies) p CROSS JOIN (SELECT DISTINCT rule_id FROM anomalies) r LEFT JOIN n USING (project_id, rule_id)""",
    "header_similarity": """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), c AS (SELECT p_partkey, w, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT w, n AS m FROM c WHERE p_partkey = 1)
        SELECT p_partkey, round(sum(least(n, coalesce(m, 0))) / (sum(n) + (SELECT sum(m) FROM t) - sum(least(n, coalesce(m, 0)))), 4) AS similarity FROM c LEFT JOIN t USING (w) GROUP BY p_partkey""",
    "template_recommendations": f"""WITH s AS ({SHEET_FACTS}), t(template_id, c) AS (VALUES {', '.join(f'({i}, {list(t)!r})' for i, t in TEMPLATES.items())}),
        j AS (SELECT sheet_id, template_id, len(list_intersect(columns, c)) AS n, len(columns) AS a, len(c) AS b FROM s, t),
        k AS (SELECT sheet_id, template_id, n = a AND n = b AS exact, round(0.75 * CASE WHEN n = a AND n = b THEN 1.0 ELSE round(n / (a + b - n), 4) END + 0.25 * n / greatest(a, b), 4) AS score FROM j WHERE n > 0)
        SELECT *, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY exact DESC, score DESC, template_id DESC) AS INTEGER) AS place FROM k WHERE score >= 0.35 QUALIFY place <= 3""",
    "table_sets": """WITH b AS (SELECT code, sum(s) AS s FROM (SELECT DISTINCT trim(code) AS code, 1 AS s FROM line_items WHERE trim(code) <> '' UNION ALL SELECT DISTINCT trim(code), 2 FROM project_version_items WHERE trim(code) <> '') GROUP BY 1)
        SELECT CASE s WHEN 3 THEN 'both' WHEN 1 THEN 'lines only' ELSE 'versions only' END AS membership, count(*) AS n FROM b GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
