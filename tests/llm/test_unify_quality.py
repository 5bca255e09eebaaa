"""Text unification and text quality: semantics and defined cases."""

import re

from pyspark.sql import functions as F

from quantora.llm import quality, unify

ODD = {"ｍ２": ["compatibility"], "m2": [], "НRB": ["lookalike"], "a​b": ["invisible"], "a\u00a0b": ["space"], "Façade": ["accent"], "Façade": [], "⼿": ["compatibility"], "m²": [], "": [], "　x": ["space"], "a\tb": ["space"], "±": ["other"]}


def test_odd_characters_and_one_form(spark):
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(ODD)] + [(99, None, None, None)], "id int, name string, canonical string, odd string")
    got = {r.value: r for r in unify.unify_text(rows, "id", ["name"]).collect()}
    for text, kinds in ODD.items():
        assert list(got[text].odd) == kinds, text
    assert got[None].canonical is None and got[None].odd is None
    assert got["ｍ２"].canonical == got["m2"].canonical == got["m²"].canonical == "m2"
    assert got["НRB"].canonical == "hrb" and got["Façade"].canonical == got["Façade"].canonical == "façade"
    assert unify.unify_text(rows.limit(0), "id", ["name", "canonical"]).count() == 0


def test_flag_is_the_ordinary_class(spark, small_data):
    rows = spark.read.parquet(f"{small_data}/line_items.parquet")
    ordinary = re.compile("[ -~一-鿿（），。；：、【】×Φ²³㎡㎥" + "".join(unify.accented_latin()) + "]*")
    for r in unify.unify_text(rows, "id", ["name", "unit"]).collect():
        if r.value is not None:
            assert bool(r.odd) != bool(ordinary.fullmatch(r.value))


TEXTS = {
    1: ("为了减少争议，双方同意以测量结果作为唯一依据，其余部分按实计量。", "prose"),
    2: ("编码|名称|单位|数量\n0101|墙|m2|12.5\n0102|柱|m3|3", "table"),
    3: ("编码: 0101\n名称: 墙\n单位: m2\n数量: 12", "table"),
    4: ("- 会议纪要2份\n- 样品\n- 签证单3份", "list"),
    5: ("1）会议纪要\n2）样品\n3）签证单", "list"),
    6: ("签字：________\n□是 □否\n____年__月__日", "junk"),
    7: ("null null null null null null null null null null null null", "junk"),
    8: ("", "junk"),
    9: (None, "junk"),
    10: ("4.1 项目部提供的签证单缺少编号和日期，无法与第14期的申报内容对应，应退回补正。", "prose"),
    11: ("The contractor is asked to confirm the extent in writing.\nThe survey of the\nroof was accepted by both sides.", "prose"),
    12: ("qwzx vbnm kjhg trpl mnbv xzcq lkjh gfds poiu ytre wqas zxcv", "junk"),
    13: ("~~~~~~~~~~\n==========\n----------", "junk"),
    14: ("编码\t名称\n0101\t墙\n0102\t柱", "table"),
}


def test_kinds_and_reasons(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, (t, _) in TEXTS.items()] + [(None, "x", "k")], "doc_id bigint, text string, kind string")
    words = spark.createDataFrame([(w, "zh") for w in "的 以 为 与 按 和 应 作为 双方".split()] + [(w, "en") for w in "the of to in by is was".split()], "word string, lang string")
    got = {r.doc_id: r for r in quality.quality(docs, words).collect()}
    for i, (text, kind) in TEXTS.items():
        assert got[i].kind == kind, (i, text, got[i])
        assert bool(got[i].reasons) == (kind != "prose")
    assert None in got and got[8].n_chars == 0 and got[8].mean_word_length == 0
    assert got[11].punctuated_line_share == 2 / 3
    assert quality.quality(docs.limit(0), words).count() == 0
    assert quality.quality(docs, words.limit(0)).filter("doc_id = 12").first().kind == "prose"  # no stop words, no such rule
    long = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("双方同意按测量结果计量，"), 20000).alias("text"))
    assert quality.quality(long, words).first().n_chars == 240000


def test_repetition_anywhere_in_a_line(spark):
    words = spark.createDataFrame([("the", "en")], "word string, lang string")
    docs = spark.createDataFrame([(1, "a long label stands here: " + "x-" * 60), (2, "a long label stands here and goes on")], "doc_id bigint, text string")
    got = {r.doc_id: r.reasons for r in quality.quality(docs, words).collect()}
    assert "repeated filler" in got[1] and "repeated filler" not in got[2]


def test_look_alikes_of_all_scripts(spark):
    table = unify.confusables(spark)
    assert len(table) > 300 and not any(map(unify.is_ordinary, map(chr, table)))
    pairs = {"Ј5": "J5", "Ꭰ3": "D3", "օ": "o", "ІІ": "II", "ＨRВ": "HRB", "e\u0301": "é", "10\u2013x": "10-x", "㎡，Φ²": "㎡，Φ²"}
    for odd, plain in pairs.items():
        assert unify.tidy_form(odd, table) == plain
        assert unify.canonical_form(odd, table) == unify.canonical_form(plain, table)
    assert unify.unify_value("★", table)[2:] == (True, ["other"])


def test_failed_rules_are_named(spark):
    words = spark.createDataFrame([("the", "en"), ("of", "en")], "word string, lang string")
    prose = "The survey of the roof was accepted by both sides of the contract, and the rest of the work goes on."
    docs = {1: "Items:\n" + "\n".join(f"{i}. {prose[:40]}" for i in range(1, 9)), 2: "\n".join([prose] * 6), 3: "# @ ~ #@ \\ " * 3 + prose, 4: prose + "\n1. cable", 5: prose}
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.kind, r.reasons) for r in quality.quality(rows, words).collect()}
    assert "bullet lines" in got[1][1] and got[1][0] == "list"
    assert got[2] == ("junk", ["repeated lines"]) and got[3][1] == ["too many symbols"]
    assert got[4] == got[5] == ("prose", [])
