"""Worksheet grids (one row per cell) turned into tables: headers found, rows classified and extracted.

A sheet is read as cells (sheet_id, row, col, value). Header cells are scored by a
dictionary join; the block of rows with most fields is the header, and its columns map
cells to fields. Everything is aggregates keyed by sheet and row, so sheets of any
size spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantora.functions.numbers import decimal_text
from quantora.functions.texts import level_label

# Header words of each field; the first of a field is its exact label.
HEADERS = {
    "code": ("清单编码", "项目编码", "编码", "code"),
    "name": ("清单名称", "项目名称", "名称", "name", "item"),
    "feature": ("项目特征", "项目特征描述", "feature"),
    "unit": ("计量单位", "单位", "unit"),
    "quantity": ("工程量", "数量", "quantity", "qty"),
    "unit_price": ("综合单价", "单价", "unit price", "rate"),
    "amount": ("合价", "金额", "amount", "sum"),
    "tax_rate": ("税率", "tax rate"),
}
# Words that end a block of rows, and of those the ones that end the sheet.
SUBTOTALS = ("小计", "合计", "总计", "本页小计", "subtotal", "total")
GRAND_TOTALS = ("合计", "总计", "grand total")
#: Rows searched for a header, fields it needs, fields that make it certain.
HEADER_ROWS, LEAST_FIELDS, SURE_FIELDS = 15, 3, 4
#: Rows that a header may have, and the confidence that needs no review.
DEEPEST, SURE = 3, 0.75
# Words of a heading that opens a section of deductions.
DEDUCTIONS = "扣款|扣减|应扣|扣除|deduction"
#: What a row may be.
CLASSES = ("detail", "deduction", "subtotal", "grand_total", "group", "orphan", "trailing", "repeated_header", "title", "figures_above", "note")


def label_key(c: Column) -> Column:
    """A header label without white space, bracketed remarks and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[(（][^)）]*[)）]", ""), "(?U)[\\s　:：]+", ""))


def header_scores(cells: DataFrame) -> DataFrame:
    """sheet_id, row, col, field, score of the cells that look like header labels (1.0 exact, 0.7 contained)."""
    spark = cells.sparkSession
    words = [(w.replace(" ", ""), f) for f, many in HEADERS.items() for w in many]
    dictionary = F.broadcast(spark.createDataFrame(words, "word string, field string"))  # the fixed list above
    top = cells.filter(F.col("row") <= HEADER_ROWS).withColumn("_k", label_key("value")).filter(F.length("_k").between(1, 20))
    hit = top.join(dictionary, F.col("_k").contains(F.col("word")))
    score = F.when(F.col("_k") == F.col("word"), 1.0).otherwise(0.7)
    ranked = hit.select("sheet_id", "row", "col", "field", score.alias("score"), F.length("word").alias("_n"))
    best = ranked.groupBy("sheet_id", "row", "col").agg(F.max(F.struct("score", "_n", "field")).alias("b"))
    return best.select("sheet_id", "row", "col", "b.field", "b.score")


def detect_headers(cells: DataFrame) -> DataFrame:
    """sheet_id, header_row, header_last, col_map (field to column), confidence, needs_review of each sheet with a header.

    A header is a block of one to DEEPEST rows. One row needs LEAST_FIELDS fields, a
    block two in its first and two in its last row. Most fields win, then the topmost
    block, then the fewest rows. A field with several columns is ambiguous and costs
    confidence; its best label, then its leftmost column counts.
    """
    scored = header_scores(cells)
    depth, start = F.col("_at.depth"), F.col("row") - F.col("_at.back")
    places = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(k).alias("back")) for d in range(1, DEEPEST + 1) for k in range(d)])
    member = scored.withColumn("_at", F.explode(places)).select("sheet_id", start.alias("first"), depth.alias("depth"), "row", "col", "field", "score")
    # In a column the lowest label counts: the parts of a heading, not the heading over them.
    member = member.groupBy("sheet_id", "first", "depth", "col").agg(F.max(F.struct("row", "field", "score")).alias("c")).select("sheet_id", "first", "depth", "c.row", "col", "c.field", "c.score")
    per_field = member.groupBy("sheet_id", "first", "depth", "field").agg(
        F.max(F.struct("score", -F.col("col"))).alias("b"), (F.count_distinct("col") > 1).alias("several"), F.bool_or(F.col("row") == F.col("first")).alias("_top"), F.bool_or(F.col("row") == F.col("first") + F.col("depth") - 1).alias("_bottom")
    )
    blocks = per_field.groupBy("sheet_id", "first", "depth").agg(
        F.count("*").alias("fields"), F.count_if(F.col("b.score") == 1.0).alias("strong"), F.count_if("several").alias("ambiguous"), F.count_if("_top").alias("_t"), F.count_if("_bottom").alias("_b"),
        F.map_from_entries(F.collect_list(F.struct("field", (-F.col("b.col2")).alias("c")))).alias("col_map"),
    )
    usable = blocks.filter((F.col("first") >= 1) & F.when(F.col("depth") == 1, F.col("fields") >= LEAST_FIELDS).otherwise((F.col("_t") >= 2) & (F.col("_b") >= 2)))
    best = usable.groupBy("sheet_id").agg(F.max_by(F.struct("first", "depth", "fields", "strong", "ambiguous", "col_map"), F.struct("fields", -F.col("first"), -F.col("depth"))).alias("h"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.25) * F.col("h.fields") + F.lit(0.08) * F.col("h.strong") - F.lit(0.1) * F.col("h.ambiguous")))
    return best.select(
        "sheet_id", F.col("h.first").alias("header_row"), (F.col("h.first") + F.col("h.depth") - 1).alias("header_last"), F.col("h.col_map").alias("col_map"), F.round(confidence, 4).alias("confidence"),
        ((confidence < SURE) | (F.col("h.fields") < SURE_FIELDS)).alias("needs_review"),
    )


def is_subtotal(name: Column) -> Column:
    """The text begins or ends as a subtotal row does."""
    bare = F.lower(F.regexp_replace(name, "(?U)[\\s　:：]+", ""))
    return bare.rlike("^(?:" + "|".join(SUBTOTALS) + ")|(?:" + "|".join(SUBTOTALS) + ")$")


def is_grand_total(name: Column) -> Column:
    """The text is a grand total."""
    return F.lower(F.regexp_replace(name, "(?U)[\\s　:：]+", "")).isin(*[g.replace(" ", "") for g in GRAND_TOTALS])


def extract_rows(cells: DataFrame) -> DataFrame:
    """The rows below each header as fields, with their class (see CLASSES but for the two above headers) and ``unparsed``.

    Rows that repeat header labels are no data. Headings are rows that number or name
    a level or have no figures; a heading of deductions opens a section that the next
    heading or total closes. Figures without name and code are ``orphan``, and
    ``trailing`` at the end of a sheet; a row of one text outside the name columns is a
    ``note``. ``unparsed`` says that a figure column holds what is no figure.
    The cells are joined to their sheet's header, and one aggregate per (sheet, row)
    turns them into fields.
    """
    headers = detect_headers(cells)
    placed = cells.join(headers.select("sheet_id", "header_last", F.explode("col_map").alias("field", "col")), ["sheet_id", "col"])
    below = placed.filter(F.col("row") > F.col("header_last"))
    fields = list(HEADERS)
    repeats = F.coalesce(*[F.when(F.col("field") == f, label_key("value").isin(*[w.replace(" ", "") for w in words])) for f, words in HEADERS.items()], F.lit(False))
    wide = below.groupBy("sheet_id", "row").agg(*[F.max(F.when(F.col("field") == f, F.nullif(F.trim("value"), F.lit("")))).alias(f) for f in fields], F.count_if(repeats).alias("_labels"))
    label = F.coalesce(F.col("name"), F.col("code"), F.lit(""))
    figures = F.coalesce("quantity", "unit_price", "amount")
    unnamed = F.col("name").isNull() & F.col("code").isNull()
    level = level_label(F.col("code")) | level_label(F.col("name"))
    kind = (
        F.when(F.col("_labels") >= LEAST_FIELDS, "repeated_header")
        .when(is_grand_total(label), "grand_total")
        .when(is_subtotal(label), "subtotal")
        .when(unnamed & figures.isNotNull(), "orphan")
        .when(unnamed, "note")
        .when(level | (figures.isNull() & F.col("unit").isNull()), "group")
        .otherwise("detail")
    )
    unparsed = F.exists(F.array("quantity", "unit_price", "amount"), lambda x: x.isNotNull() & decimal_text(x).isNull())
    rows = wide.withColumn("class", kind).withColumn("unparsed", F.coalesce(unparsed, F.lit(False)) & F.col("class").isin("detail", "subtotal", "grand_total", "orphan")).drop("_labels")
    # What the heading above opens; a sheet is no larger than its file format lets it be.
    opens = F.when(F.col("class") == "group", label.rlike(DEDUCTIONS)).when(F.col("class").isin("subtotal", "grand_total"), F.lit(False))
    inside = F.coalesce(F.last(opens, ignorenulls=True).over(Window.partitionBy("sheet_id").orderBy("row")), F.lit(False))
    rows = rows.withColumn("class", F.when((F.col("class") == "detail") & inside, "deduction").otherwise(F.col("class")))
    # The last row that is none of them, as an aggregate.
    last = rows.filter("class <> 'orphan'").groupBy("sheet_id").agg(F.max("row").alias("_last"))
    ended = rows.join(last, "sheet_id", "left")
    return ended.withColumn("class", F.when((F.col("class") == "orphan") & (F.col("row") > F.coalesce("_last", F.lit(-1))), "trailing").otherwise(F.col("class"))).drop("_last")


def rows_above(cells: DataFrame) -> DataFrame:
    """sheet_id, row and class of the rows above each header: ``figures_above`` (two figures or more: data before the header) or ``title``."""
    headers = detect_headers(cells).select("sheet_id", "header_row")
    above = cells.join(headers, "sheet_id").filter((F.col("row") < F.col("header_row")) & (F.trim("value") != ""))
    g = above.groupBy("sheet_id", "row").agg(F.count_if(decimal_text(F.col("value")).isNotNull()).alias("_n"))
    return g.select("sheet_id", "row", F.when(F.col("_n") >= 2, "figures_above").otherwise("title").alias("class"))


def coverage(cells: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per sheet: filled rows, rows by class, rows whose figures cannot be read, and the proof that every row is accounted for.

    ``proof``: incomplete if a filled row has no class, else doubtful if data stand above
    the header or figures cannot be read, else complete.
    """
    filled = cells.filter(F.trim("value") != "").join(detect_headers(cells).select("sheet_id", "header_row", "header_last"), "sheet_id")
    filled = filled.filter((F.col("row") < F.col("header_row")) | (F.col("row") > F.col("header_last"))).groupBy("sheet_id").agg(F.count_distinct("row").alias("n_rows"))
    every = extracted.select("sheet_id", "row", "class", "unparsed").unionByName(rows_above(cells).withColumn("unparsed", F.lit(False)))
    counted = every.groupBy("sheet_id").agg(*[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in CLASSES], F.count_if("unparsed").alias("n_unparsed"), F.count("*").alias("_all"))
    none = lambda c: F.coalesce(c, F.lit(0))
    joined = filled.join(counted, "sheet_id", "left")
    proof = F.when(F.col("n_rows") != none("_all"), "incomplete").when((none("n_figures_above") > 0) | (none("n_unparsed") > 0), "doubtful").otherwise("complete")
    return joined.select("sheet_id", "n_rows", *[none(f"n_{c}").alias(f"n_{c}") for c in (*CLASSES, "unparsed")], proof.alias("proof"))


def form_like(cells: DataFrame) -> DataFrame:
    """Per sheet: strong, weak or none, by the share of its rows that are one label and one value."""
    rows = cells.filter(F.trim("value") != "").groupBy("sheet_id", "row").agg(F.count("*").alias("n"), F.bool_or(F.col("value").rlike("[:：]\\s*$")).alias("label"))
    sheets = rows.groupBy("sheet_id").agg(F.count("*").alias("_rows"), F.count_if((F.col("n") <= 2) & F.col("label")).alias("_form"))
    share = F.try_divide(F.col("_form"), F.col("_rows"))
    return sheets.select("sheet_id", F.when(share >= 0.6, "strong").when(share >= 0.3, "weak").otherwise("none").alias("form"))


#: Weights of equal labels and of common fields in a template's score, the least score, and recommendations per sheet.
LABEL_WEIGHT, FIELD_WEIGHT, LEAST_SCORE, RECOMMENDED = 0.75, 0.25, 0.35, 10


def recommend_templates(sheets: DataFrame, templates: DataFrame, limit: int = RECOMMENDED, least: float = LEAST_SCORE) -> DataFrame:
    """sheet_id, template_id, score, exact and place of the templates that a sheet's header resembles; proposals, never applied.

    ``sheets`` has sheet_id, labels and fields (arrays), ``templates`` template_id,
    labels and fields. Labels are compared as multisets (their intersection over their
    union; one for equal ones), fields by the common ones over the longer list. The
    templates are a kept list and meet only sheets with which they share a label.
    """
    key = lambda c: F.filter(F.transform(c, label_key), lambda x: x != "")
    named = lambda df, i, n: df.select(i, F.sort_array(key(F.col("labels"))).alias(f"_{n}l"), F.array_distinct("fields").alias(f"_{n}f"))
    own, kept = named(sheets, "sheet_id", "s"), named(templates, "template_id", "t")
    counted = lambda df, i, n: df.select(i, F.explode(f"_{n}l").alias("label")).groupBy(i, "label").agg(F.count("*").alias(f"_{n}n"))
    shared = counted(own, "sheet_id", "s").join(counted(kept, "template_id", "t"), "label").groupBy("sheet_id", "template_id").agg(F.sum(F.least("_sn", "_tn")).alias("_both"))
    j = shared.join(own, "sheet_id").join(kept, "template_id")
    exact = F.col("_sl") == F.col("_tl")
    labels = F.when(exact, F.lit(1.0)).otherwise(F.round(F.col("_both") / (F.size("_sl") + F.size("_tl") - F.col("_both")), 4))
    fields = F.when(F.size("_sf") > 0, F.size(F.array_intersect("_sf", "_tf")) / F.greatest(F.size("_sf"), F.size("_tf"))).otherwise(F.lit(0.0))
    scored = j.select("sheet_id", "template_id", exact.alias("exact"), F.round(LABEL_WEIGHT * labels + FIELD_WEIGHT * fields, 4).alias("score")).filter(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.desc("exact"), F.desc("score"), F.desc("template_id")))  # at most one row a template
    return scored.withColumn("place", place).filter(F.col("place") <= limit)
