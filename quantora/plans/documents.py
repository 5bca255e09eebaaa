"""Queries over texts, pages, flags and formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.functions import texts as T
from quantora.functions.numbers import decimal_text, tax_fraction, to_decimal
from quantora.operators import formulas, grid
from quantora.plans.domain import boq, over_boq
from quantora.plans.sheets import AMOUNT_CELLS
from quantora.session import cut_lineage
from quantora.sources.tables import table

# Facts of contract paragraphs: trigger words, where the value stands (a pattern, ``days`` for a time limit
# anywhere in the paragraph, or nothing), and the confidence of a fact with its value.
_MONEY = "([¥￥]\\s*[0-9,，]+(?:\\.[0-9]+)?\\s*(?:万元|亿元|元)?|[0-9]{1,3}(?:[,，][0-9]{3})+(?:\\.[0-9]+)?\\s*(?:万元|亿元|元)?|[0-9]{4,}(?:\\.[0-9]+)?\\s*(?:万元|亿元|元)?)"
_DAYS = "([0-9]+\\s*(?:个)?\\s*(?:日历天|工作日|天|日内))"
FACTS = {
    "contractor_party": ("承包人|承包方|乙方|施工单位", "(?:承包人|承包方|乙方|施工单位)[：:为\\s]*([^\\s，。；、]{2,30})", 0.9),
    "employer_party": ("发包人|发包方|甲方|建设单位", "(?:发包人|发包方|甲方|建设单位)[：:为\\s]*([^\\s，。；、]{2,30})", 0.9),
    "contract_amount": ("合同价|合同总价|签约合同价|合同金额", "(?:合同价[款格]?|合同总价|签约合同价|合同金额)[^0-9]{0,20}" + _MONEY, 0.9),
    "duration": ("工期|计划开工|计划竣工|开工日期|竣工日期", "days", 0.8),
    "pricing_method": ("固定总价|固定单价|可调价格|可调单价|成本加酬金|单价合同|总价合同", "(固定总价|固定单价|可调价格|可调单价|成本加酬金|单价合同|总价合同)", 0.9),
    "price_adjustment": ("调价|价格调整|价差|价格波动|人工费调整|信息价", None, 0.6),
    "variation_clause": ("工程变更|设计变更|变更估价|变更指示", None, 0.6),
    "visa_clause": ("现场签证|工程签证|签证单", None, 0.6),
    "settlement_clause": ("竣工结算|结算审核|结算办理|结算书", "days", 0.7),
    "payment_clause": ("预付款|进度款|付款|支付", "days", 0.7),
    "tax_clause": ("增值税|税率|发票|含税|不含税|税金", "税率[为是：:\\s]*([0-9.]+\\s*%?)", 0.8),
    "breach_clause": ("违约|罚款|赔偿金|履约保证金", None, 0.6),
    "claim_clause": ("索赔", "days", 0.7),
    "approval_requirement": ("审批|审核批准|经.{0,6}批准|报.{0,6}审批", None, 0.5),
    "responsible_party": ("由.{0,12}(?:承包人|发包人|监理|建设单位|施工单位)负责", "由[^。]{0,12}?(承包人|发包人|监理|建设单位|施工单位)负责", 0.8),
}
# Clauses that a contract must have with the severity of their lack, and the confidence of a fact that is only mentioned.
REQUIRED = {"payment_clause": "high", "settlement_clause": "high", "duration": "medium", "contract_amount": "medium", "tax_clause": "medium", "pricing_method": "medium"}
MENTIONED = 0.4
# Words of sentences that set a rate.
RATE_WORDS = "管理费|协作费|配合费|费率|收取|计取|点数|个百分点|利润率|采保|上缴|缴纳|保证金|奖励|rate|retention"


def text_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts of each paragraph of each document, with value and confidence; facts without a value are mentioned. One pass, no join."""
    p = F.col("paragraph")

    def fact(name: str, trigger: str, where: str | None, confidence: float):
        value = F.nullif(F.regexp_extract(p, _DAYS if where == "days" else where, 1), F.lit("")) if where else F.lit(None).cast("string")
        missed = MENTIONED if where is None or confidence < 0.9 else confidence
        return F.when(p.rlike(trigger), F.struct(F.lit(name).alias("fact"), F.regexp_replace(value, "[\\s,，]", "").alias("value"), F.when(value.isNotNull(), F.lit(max(confidence, 0.7) if where == "days" else confidence)).otherwise(F.lit(missed)).alias("confidence")))

    paragraphs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph_no", "paragraph"))
    found = F.array_compact(F.array(*[fact(k, *v) for k, v in FACTS.items()]))
    return paragraphs.select("doc_id", "paragraph_no", F.explode(found).alias("f")).select("doc_id", "paragraph_no", "f.*")


def missing_facts(spark: SparkSession, d: str) -> DataFrame:
    """Which of the required clauses each contract lacks in all its documents, and which it only mentions."""
    keys = table(spark, d, "documents").select("doc_id", "contract_key").filter("contract_key is not null")
    have = text_facts(spark, d).filter(F.col("fact").isin(*REQUIRED)).join(keys, "doc_id").groupBy("contract_key", "fact").agg(F.max("confidence").alias("_best"))
    required = F.broadcast(spark.createDataFrame(list(REQUIRED.items()), "fact string, severity string"))  # the fixed list above
    every = keys.select("contract_key").distinct().join(required).join(have, ["contract_key", "fact"], "left")
    state = F.when(F.col("_best").isNull(), "missing").when(F.col("_best") <= MENTIONED, "mentioned")
    return every.select("contract_key", "fact", "severity", state.alias("state")).filter("state is not null")


def rate_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Rates named in sentences about fees, each sentence and rate once; a rate given by a formula is left to a person."""
    said = table(spark, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    about = said.filter(F.col("sentence").rlike(RATE_WORDS))
    rates = F.array_distinct(T.percentages(F.col("sentence")))
    formula = F.col("sentence").rlike("[%％]")
    named = F.when(F.size(rates) > 0, F.transform(rates, lambda r: F.struct(r.alias("rate"), F.lit(False).alias("manual")))).when(formula, F.array(F.struct(F.lit(None).cast("double").alias("rate"), F.lit(True).alias("manual"))))
    return about.select("doc_id", "sentence", F.explode(named).alias("r")).groupBy("sentence", "r.rate", "r.manual").agg(F.count_distinct("doc_id").alias("n_documents"))


def page_states(spark: SparkSession, d: str) -> DataFrame:
    """Per file: pages by state, and whether the file may be used (every page read, none missing)."""
    p = table(spark, d, "pdf_pages")
    done = F.col("status").isin("native_text", "ocr")
    g = p.groupBy("file_id").agg(F.count_distinct("page_number").alias("n_pages"), F.count_if(done).alias("n_read"), F.count_if(~done).alias("n_open"), F.max("page_number").alias("_last"))
    return g.select("file_id", "n_pages", "n_read", "n_open", ((F.col("n_open") == 0) & (F.col("_last") == F.col("n_pages"))).alias("usable"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Non-empty lines of all pages, numbered within their page, counted per file and page."""
    lines = table(spark, d, "pdf_pages").select("page_id", "file_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    return lines.filter(F.col("line").rlike("\\S")).groupBy("page_id", "file_id").agg(F.count("*").alias("n_lines"), (F.max("i") + 1).alias("last_line"))


def line_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of the lines read from their JSON: unreadable JSON has none."""
    j = F.col("flags_json")
    get = lambda k: F.get_json_object(j, f"$.{k}")
    rows = table(spark, d, "line_items").select("id", get("row").try_cast("int").alias("row"), F.coalesce(get("subtotal") == "true", F.lit(False)).alias("subtotal"), F.coalesce(get("grand_total") == "true", F.lit(False)).alias("grand_total"))
    return rows


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Events by the value of a JSON property."""
    return table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type").groupBy("k", "event_type").agg(F.count("*").alias("n"))


def cleaned_figures(spark: SparkSession, d: str) -> DataFrame:
    """Quantity, price, amount and tax rate of every line as exact figures, whatever their notation."""
    f = lambda c: to_decimal(F.col(c), "decimal(24,6)").cast("double").alias(c)
    return table(spark, d, "line_items").select("id", f("unit_price"), f("amount"), tax_fraction(F.col("tax_rate")).cast("double").alias("tax_rate"))


def unparsed_figures(spark: SparkSession, d: str) -> DataFrame:
    """Texts in figure columns that are no figure, counted per column and text."""
    cols = ("quantity", "unit_price", "amount")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text"), decimal_text(F.col(c)).alias("figure")) for c in cols])).alias("f")
    rows = table(spark, d, "line_items").select(each).select("f.*").filter("figure is null and trim(text) <> ''")
    return rows.groupBy("field", "text").agg(F.count("*").alias("n"))


def period_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Period numbers read from titles, beside the recorded ones."""
    rows = table(spark, d, "settlement_periods").select("id", "title", "period_no", T.period_number(F.col("title")).alias("read_no"))
    return rows.select("id", "read_no", F.coalesce(F.col("read_no") == F.col("period_no"), F.lit(False)).alias("agrees"))


def line_buildings(spark: SparkSession, d: str) -> DataFrame:
    """The buildings that descriptions name, with the number of lines of each."""
    rows = table(spark, d, "line_items").select(F.explode(T.building_tokens(F.coalesce("feature", F.lit("")))).alias("building"))
    return rows.groupBy("building").agg(F.count("*").alias("n_lines"))


def tax_modes(spark: SparkSession, d: str) -> DataFrame:
    """Directions of a project whose periods mix tax modes."""
    known = table(spark, d, "settlement_periods").filter("tax_mode is not null and tax_mode not in ('', 'unknown')")
    return known.groupBy("project_id", "direction").agg(F.count_distinct("tax_mode").alias("n_modes")).filter("n_modes > 1")


def _grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """The items laid out as worksheets: one sheet per direction and period, a title, a header, one row per item, a total."""
    from pyspark.sql import Window

    rows = boq(spark, d).withColumn("sheet_id", F.concat_ws(":", "direction", "period_no"))
    numbered = rows.withColumn("row", F.row_number().over(Window.partitionBy("sheet_id").orderBy("rid")) + 3)
    labels = ("清单编码", "清单名称", "项目特征", "计量单位", "工程量（t）", "综合单价", "合价", "税率")
    fields = ("code", "name", "feature", "unit", "quantity", "unit_price", "amount", "tax_rate")
    body = numbered.select("sheet_id", "row", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("col"), F.col(f).cast("string").alias("value")) for i, f in enumerate(fields)])).alias("c")).select("sheet_id", "row", "c.*")
    sheets = numbered.groupBy("sheet_id").agg(F.max("row").alias("_last"), F.sum("amount").alias("_sum"))
    # Even periods have a header of two rows: the amounts' labels stand below one for all of them.
    low, even = labels[5:], F.split_part("sheet_id", F.lit(":"), F.lit(2)).cast("int") % 2 == 0
    cell = lambda row, col, text: F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), F.lit(text).alias("value"))
    one_row = F.array(cell(1, 1, "工程结算书"), *[cell(3, i + 1, x) for i, x in enumerate(labels)])
    two_rows = F.array(cell(1, 1, "工程结算书"), *[cell(2, i + 1, x) for i, x in enumerate((*labels[:5], "其中"))], *[cell(3, i + 6, x) for i, x in enumerate(low)])
    head = sheets.select("sheet_id", F.explode(F.when(even, two_rows).otherwise(one_row)).alias("c")).select("sheet_id", "c.*")
    foot = sheets.select("sheet_id", (F.col("_last") + 1).alias("row"), F.explode(F.array(F.struct(F.lit(2).alias("col"), F.lit("合 计").alias("value")), F.struct(F.lit(7).alias("col"), F.col("_sum").cast("string").alias("value")))).alias("c")).select("sheet_id", "row", "c.*")
    return head.unionByName(body).unionByName(foot).filter("value is not null and value <> ''")


def _faulty_cells(spark: SparkSession, d: str) -> DataFrame:
    """The worksheets with a fault by period, so that checks have something to find.

    By period number modulo 5: figures without a name below the total, a total that is
    ten too high, the last item left out, the total stated twice, no total.
    """
    cells = cut_lineage(_grid_cells(spark, d))
    last = cells.groupBy("sheet_id").agg(F.max("row").alias("_last"))
    fault = F.split_part("sheet_id", F.lit(":"), F.lit(2)).cast("int") % 5
    placed = cells.join(last, "sheet_id").withColumn("_fault", fault)
    total = F.col("row") == F.col("_last")
    kept = placed.filter(~((F.col("_fault") == 2) & (F.col("row") == F.col("_last") - 1)) & ~((F.col("_fault") == 4) & total))
    wrong = (F.col("_fault") == 1) & total & (F.col("col") == 7)
    changed = kept.withColumn("value", F.when(wrong, (F.col("value").cast("decimal(38,6)") + 10).cast("string")).otherwise(F.col("value")))
    again = placed.filter((F.col("_fault") == 3) & total).withColumn("row", F.col("row") + 1)
    orphan = placed.filter((F.col("_fault") == 0) & total & (F.col("col") == 7)).withColumn("row", F.col("row") + 1)
    return changed.unionByName(again).unionByName(orphan).select("sheet_id", "row", "col", "value")


def grid_items(spark: SparkSession, d: str) -> DataFrame:
    """Items laid out as worksheet cells and read back: header found, rows classified, figures parsed."""
    rows = grid.extract_rows(_grid_cells(spark, d)).filter("class = 'detail'")
    return rows.select("sheet_id", F.coalesce("code", F.lit("")).alias("code"), "name", "unit", to_decimal(F.col("quantity")).cast("double").alias("quantity"), to_decimal(F.col("amount")).cast("double").alias("amount"))


def grid_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every worksheet row accounted for by class, also of worksheets with faults."""
    cells = cut_lineage(_faulty_cells(spark, d))
    return grid.coverage(cells, grid.extract_rows(cells)).select("sheet_id", "n_rows", "n_detail", "n_grand_total", "n_title", "n_trailing", "proof")


def formula_impact(spark: SparkSession, d: str) -> DataFrame:
    """What the regions but one reach through nations, suppliers and customers: a dependency graph followed breadth first."""
    n = table(spark, d, "nation")
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target"))
    edges = edges.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("s"), "s_suppkey").alias("target")))
    edges = edges.unionByName(table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("source"), F.concat(F.lit("c"), "c_custkey").alias("target")))
    seeds = n.select(F.concat(F.lit("r"), "n_regionkey").alias("node")).filter("node <> 'r4'")
    return formulas.impact(edges, seeds)


def _amount_formulas(spark: SparkSession, d: str) -> DataFrame:
    """The formulas of the amount column, one per sheet and row (the smallest line's)."""
    from quantora.plans.sheets import amount_cells

    cells = amount_cells(spark, d).filter("formula is not null and sheet_id is not null")
    return cells.groupBy(F.col("sheet_id").cast("string").alias("sheet"), "row").agg(F.min_by("formula", "line_id").alias("formula")).withColumn("col", F.lit(7))


def formula_dependents(spark: SparkSession, d: str) -> DataFrame:
    """The cells that amount formulas read, with how many read them."""
    return formulas.direct_dependents(formulas.formula_edges(_amount_formulas(spark, d))).withColumnRenamed("source_sheet", "sheet")


def formula_reads(spark: SparkSession, d: str) -> DataFrame:
    """Every amount formula with its status and the number of cells that it reads."""
    return formulas.formula_report(_amount_formulas(spark, d)).drop("col")


def column_names(spark: SparkSession, d: str) -> DataFrame:
    """Column letters of the numbers of all parts (1 to 18278)."""
    n = (F.pmod(F.col("p_partkey") * 37, F.lit(18278)) + 1).cast("int")
    return table(spark, d, "part").select("p_partkey", n.alias("number")).select("p_partkey", "number", formulas.column_letters(F.col("number")).alias("letters"))


_FIG = "translate(regexp_replace({c}, '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), '０１２３４５６７８９．，（）－＋％￥', '0123456789.,()-+%¥')"


def _sql_decimal(c: str) -> str:
    flat = f"regexp_replace(regexp_replace({_FIG.format(c=c)}, '[,\\s¥$€£\\x{{00A0}}\\x{{3000}}]|^人民币|元$', '', 'g'), '^\\(([^()+-]*)\\)$', '-\\1')"
    return f"CASE WHEN regexp_full_match({flat}, '-?[0-9]*\\.?[0-9]*') AND regexp_matches({flat}, '[0-9]') THEN TRY_CAST({flat} AS DECIMAL(24,6)) END"


def _fact_sql(fact: str, trigger: str, where: str | None, confidence: float) -> str:
    value = f"nullif(regexp_replace(nullif(regexp_extract(p, '{_DAYS if where == 'days' else where}', 1), ''), '[\\s,，]', '', 'g'), '')" if where else "CAST(NULL AS VARCHAR)"
    missed = MENTIONED if where is None or confidence < 0.9 else confidence
    best = max(confidence, 0.7) if where == "days" else confidence
    return f"SELECT doc_id, CAST(i AS INTEGER) AS paragraph_no, '{fact}' AS fact, {value} AS value, CAST(CASE WHEN {value} IS NOT NULL THEN {best} ELSE {missed} END AS DOUBLE) AS confidence FROM p WHERE regexp_matches(p, '{trigger}')"


_TAX = "regexp_replace(" + _FIG.format(c="tax_rate") + ", '\\s', '', 'g')"
ORACLES = {
    "text_facts": "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) "
    + " UNION ALL ".join(_fact_sql(k, *v) for k, v in FACTS.items()),
    "rate_candidates": """WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[。；;！!？?\\n]')), ' ') AS sentence FROM documents),
        r AS (SELECT doc_id, sentence, list_distinct(list_transform(regexp_extract_all(sentence, '([0-9]+(?:\\.[0-9]+)?)\\s*(?:%|％|个点|percent)', 1), lambda x: CAST(x AS DOUBLE))) AS rates FROM s WHERE regexp_matches(sentence, '__WORDS__')),
        e AS (SELECT doc_id, sentence, unnest(rates) AS rate, false AS manual FROM r UNION ALL SELECT doc_id, sentence, NULL, true FROM r WHERE len(rates) = 0 AND regexp_matches(sentence, '[%％]'))
        SELECT sentence, rate, manual, count(DISTINCT doc_id) AS n_documents FROM e GROUP BY ALL""".replace("__WORDS__", RATE_WORDS),
    "page_states": """SELECT file_id, count(DISTINCT page_number) AS n_pages, count(*) FILTER (WHERE status IN ('native_text', 'ocr')) AS n_read, count(*) FILTER (WHERE status NOT IN ('native_text', 'ocr')) AS n_open,
        count(*) FILTER (WHERE status NOT IN ('native_text', 'ocr')) = 0 AND max(page_number) = count(DISTINCT page_number) AS usable FROM pdf_pages GROUP BY file_id""",
    "page_lines": """WITH l AS (SELECT page_id, file_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pdf_pages)
        SELECT page_id, file_id, count(*) AS n_lines, CAST(max(i) AS INTEGER) AS last_line FROM l WHERE regexp_matches(line, '\\S') GROUP BY ALL""",
    "line_flags": """SELECT id, CAST(json_extract_string(flags_json, '$.row') AS INTEGER) AS row, coalesce(json_extract_string(flags_json, '$.subtotal') = 'true', false) AS subtotal,
        coalesce(json_extract_string(flags_json, '$.grand_total') = 'true', false) AS grand_total FROM line_items""",
    "event_properties": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, count(*) AS n FROM events GROUP BY ALL",
    "cleaned_figures": f"""SELECT id, CAST({_sql_decimal('unit_price')} AS DOUBLE) AS unit_price, CAST({_sql_decimal('amount')} AS DOUBLE) AS amount,
        CAST(CASE WHEN s > 1 THEN s / 100 ELSE s END AS DOUBLE) AS tax_rate FROM (SELECT *, CASE WHEN {_TAX} LIKE '%\\%' ESCAPE '\\' THEN TRY_CAST(replace({_TAX}, '%', '') AS DOUBLE) / 100 ELSE TRY_CAST({_TAX} AS DOUBLE) END AS s FROM line_items)""",
    "unparsed_figures": " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS text, count(*) AS n FROM line_items WHERE trim({c}, ' ') <> '' AND ({_sql_decimal(c)}) IS NULL GROUP BY {c}" for c in ("quantity", "unit_price", "amount")),
    "tax_modes": "SELECT project_id, direction, count(DISTINCT tax_mode) AS n_modes FROM settlement_periods WHERE tax_mode NOT IN ('', 'unknown') GROUP BY ALL HAVING count(DISTINCT tax_mode) > 1",
    "grid_items": over_boq("SELECT direction || ':' || period_no AS sheet_id, code, name, unit, CAST(quantity AS DOUBLE) AS quantity, CAST(amount AS DOUBLE) AS amount FROM boq"),
    "grid_coverage": over_boq(
        """SELECT direction || ':' || period_no AS sheet_id, count(*) + 1 + CASE period_no % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 0 END AS n_rows, count(*) - CASE period_no % 5 WHEN 2 THEN 1 ELSE 0 END AS n_detail,
        CASE period_no % 5 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS n_grand_total, 1 AS n_title, CASE period_no % 5 WHEN 0 THEN 1 ELSE 0 END AS n_trailing, 'complete' AS proof FROM boq GROUP BY direction, period_no"""
    ),
    "formula_impact": """WITH RECURSIVE e(s, t) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
        r(node, depth) AS (SELECT DISTINCT 'r' || n_regionkey, 0 FROM nation WHERE n_regionkey <> 4 UNION SELECT t, depth + 1 FROM r JOIN e ON s = node) SELECT node, depth, true AS complete FROM r""",
    "formula_dependents": f"""WITH g AS (SELECT CAST(sheet_id AS VARCHAR) AS sheet, row, arg_min(line_id % 6, line_id) AS k FROM ({AMOUNT_CELLS}) WHERE formula IS NOT NULL AND sheet_id IS NOT NULL GROUP BY ALL),
        e AS (SELECT sheet, row AS target, row AS source_row, 5 AS source_col FROM g WHERE k IN (0, 1, 3, 5) UNION ALL SELECT sheet, row, row + CASE WHEN k = 1 THEN 1 ELSE 0 END, 6 FROM g WHERE k IN (0, 1, 3, 5)
          UNION ALL SELECT sheet, row, unnest(range(4, 10)), 7 FROM g WHERE k = 4)
        SELECT sheet, CAST(source_row AS INTEGER) AS source_row, CAST(source_col AS INTEGER) AS source_col, count(DISTINCT target) AS n_dependents FROM e GROUP BY ALL""",
    "formula_reads": f"""WITH g AS (SELECT CAST(sheet_id AS VARCHAR) AS sheet, row, arg_min(line_id % 6, line_id) AS k FROM ({AMOUNT_CELLS}) WHERE formula IS NOT NULL AND sheet_id IS NOT NULL GROUP BY ALL)
        SELECT sheet, row, 'ok' AS status, CAST(CASE WHEN k = 4 THEN 6 ELSE 2 END AS INTEGER) AS n_references FROM g""",
    "column_names": """WITH n AS (SELECT p_partkey, CAST((p_partkey * 37) % 18278 + 1 AS INTEGER) AS number FROM part)
        SELECT p_partkey, number, CASE WHEN number <= 26 THEN chr(64 + number) WHEN number <= 702 THEN chr(CAST(65 + (number - 27) // 26 AS INTEGER)) || chr(CAST(65 + (number - 1) % 26 AS INTEGER))
        ELSE chr(CAST(65 + (number - 703) // 676 AS INTEGER)) || chr(CAST(65 + ((number - 27) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (number - 1) % 26 AS INTEGER)) END AS letters FROM n""",
    "line_buildings": """WITH g AS (SELECT unnest(regexp_extract_all(feature, '([0-9]+)号楼', 1)) AS b FROM line_items) SELECT CAST(b AS INTEGER) AS building, count(*) AS n_lines FROM g GROUP BY 1""",
    "period_numbers": """WITH r AS (SELECT id, period_no, coalesce(TRY_CAST(nullif(regexp_extract(title, '第\\s*([0-9]+)\\s*期', 1), '') AS INTEGER),
          CASE regexp_extract(title, '第\\s*([一二三四五六七八九十]+)\\s*期', 1) WHEN '一' THEN 1 WHEN '二' THEN 2 WHEN '三' THEN 3 WHEN '四' THEN 4 WHEN '五' THEN 5 WHEN '六' THEN 6 WHEN '七' THEN 7 WHEN '八' THEN 8 WHEN '九' THEN 9 WHEN '十' THEN 10 WHEN '十一' THEN 11 WHEN '十二' THEN 12 END,
          TRY_CAST(nullif(regexp_extract(title, '(?i)period\\s+([0-9]+)', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(title, '^([0-9]+)期', 1), '') AS INTEGER)) AS read_no FROM settlement_periods)
        SELECT id, read_no, coalesce(read_no = period_no, false) AS agrees FROM r""",
}
ORACLES["missing_facts"] = f"""WITH f AS ({ORACLES['text_facts']}), k AS (SELECT doc_id, contract_key FROM documents WHERE contract_key IS NOT NULL), h AS (SELECT contract_key, fact, max(confidence) AS best FROM f JOIN k USING (doc_id) GROUP BY ALL)
    SELECT c.contract_key, x.fact, x.severity, CASE WHEN best IS NULL THEN 'missing' ELSE 'mentioned' END AS state FROM (SELECT DISTINCT contract_key FROM k) c CROSS JOIN (VALUES {', '.join(map(str, REQUIRED.items()))}) x(fact, severity) LEFT JOIN h USING (contract_key, fact) WHERE best IS NULL OR best <= {MENTIONED}"""
QUERIES = {name: globals()[name] for name in ORACLES}
