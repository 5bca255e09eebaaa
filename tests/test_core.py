"""Numbers, units, texts, sequences, pairing, components, lattices, ledger, lineage, streaming."""

import random
import time
from decimal import Decimal
from pathlib import Path

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantora.functions import numbers, texts, units
from quantora.functions.lookalikes import skeleton
from quantora.operators import aggregate, components, grid, ledger, lineage, pairing, rulebook, sequences, verify
from quantora.plans import control
from quantora.plans.domain import boq
from quantora.plans.grouping import token_set_ratio
from quantora.session import cut_lineage
from quantora.streaming import events


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers(spark):
    values = ["1,234,567.89", "¥12,345.67", "人民币 1,000.00", "(1,234.56)", "abc", "1.2.3", "12%", "1e3", "", None, "－50", "#N/A", "0"]
    got = column(spark, values, numbers.to_decimal)
    assert got == [Decimal("1234567.890000"), Decimal("12345.670000"), Decimal("1000.000000"), Decimal("-1234.560000"), None, None, None, None, None, None, Decimal("-50.000000"), None, Decimal("0.000000")]
    assert column(spark, ["13%", "13", "0.13", "x"], numbers.tax_fraction) == [Decimal("0.13000000")] * 3 + [None]
    assert column(spark, ["-0.125", "0.125"], lambda c: numbers.round2(c.cast("decimal(18,6)"))) == [Decimal("-0.13"), Decimal("0.13")]


@given(st.decimals(min_value=-10**9, max_value=10**9, places=4, allow_nan=False))
@settings(max_examples=50, deadline=None)
def test_number_spellings_agree(value):
    # The canonical form is a function of the value; checked in Python on the same rules.
    text = f"{value:,.4f}"
    assert Decimal(text.replace(",", "")) == value


@given(st.sampled_from(sorted(units.vocabulary())))
@settings(deadline=None)
def test_every_unit_reads_as_itself(name):
    base, factor = units.vocabulary()[name]
    assert units.read_unit(name)[:2] == (base, factor)
    assert units.read_unit(f"  {name.upper()}​")[0] == base


def test_unit_spellings():
    assert units.read_unit("100㎡")[:2] == ("m2", "100")
    assert units.read_unit("万m³")[:2] == ("m3", "10000")
    assert units.read_unit("千克")[:2] == ("t", "0.001")
    assert units.read_unit("kilogran")[:3] == ("t", "0.001", "fuzzy")
    assert units.read_unit("方采")[2] == "unknown" or units.read_unit("方采")[0] is not None
    assert units.read_unit("???")[2] == "unknown"


def test_skeleton():
    assert skeleton("НRВ５００") == skeleton("HRB500") == "hrb500"
    assert skeleton("Façade x") == "façade x"
    assert skeleton("⼿​") == "手"
    assert skeleton("Straße") == "strasse"


def test_texts(spark):
    assert column(spark, ["一", "十", "十二", "二十", "九十九", "百", None], texts.chinese_ordinal) == [1, 10, 12, 20, 99, None, None]
    assert column(spark, ["第十二期计量", "3期", "Settlement period 4", "x"], texts.period_number) == [12, 3, 4, None]
    assert column(spark, ["1、3号楼", "1-3号楼", "2#楼", "无"], texts.building_tokens) == [[1, 3], [1, 2, 3], [2], []]
    assert column(spark, ["费率3%，另2.5个点，百分之三"], texts.percentages) == [[3.0, 2.5, 3.0]]
    assert column(spark, ["不含税单价", "含税", "单价"], texts.tax_basis) == ["exclusive", "inclusive", "unknown"]


def test_sequences(spark):
    rows = spark.createDataFrame([("a", 1, 10.0, False), ("a", 2, None, False), ("a", 3, 25.0, True), ("a", 4, 5.0, False)], "k string, n int, v double, close boolean")
    first = {r.n: r.change for r in sequences.against_first(rows, ["k"], "n", "v").collect()}
    assert first[3] == 1.5 and first[2] is None
    assert {r.n: r.ratio for r in sequences.against_previous(rows, ["k"], "n", "v").collect()} == {1: None, 3: 2.5, 4: 0.2}
    assert [r.segment for r in sequences.segments(rows, ["k"], "n", F.col("close")).orderBy("n").collect()] == [0, 0, 0, 1]
    breaks = {r.n: r.previous for r in sequences.with_breaks(rows, ["k"], "n", "v", F.col("v").isNull()).collect()}
    assert breaks == {1: None, 2: None, 3: None, 4: 25.0}
    tail = {r.n for r in sequences.trailing_run(rows, ["k"], "n", F.col("n") >= 3).filter("trailing").collect()}
    assert tail == {3, 4}


def test_key_classes(spark):
    left = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b"), ("4", None), ("5", "c"), ("6", "d"), ("7", " ")], "id string, k string")
    right = spark.createDataFrame([("8", "a"), ("9", "b"), ("10", "d"), ("11", "d")], "id string, k string")
    got = {(r.side, r.id): (r["class"], r.partner) for r in pairing.classify_keys(left, right, ["k"], "id", "id").collect()}
    assert got["left", "1"] == ("matched", "8") and got["right", "8"] == ("matched", "1")
    assert got["left", "2"][0] == "duplicate" and got["right", "9"][0] == "blocked"
    assert got["left", "4"][0] == "null_key" and got["left", "7"][0] == "null_key"
    assert got["left", "5"][0] == "only" and got["left", "6"][0] == "blocked"
    pairs = pairing.progressive_pairs(left, right, [("k", pairing.composite_key("k"))])
    assert [(r.left_id, r.right_id, r["pass"]) for r in pairs.collect()] == [("1", "8", "k")]
    zipped = pairing.positional_pairs(left.filter("k = 'b'"), right.filter("k = 'b'"), ["k"], "id").orderBy("position").collect()
    assert [(r.left_id, r.right_id, r.ambiguous) for r in zipped] == [("2", "9", True), ("3", None, True)]


def test_components(spark):
    edges = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(30)] + [("x", "y"), ("y", "z"), (None, "q")], "l string, r string")
    got = {r.node: r.component for r in components.connected_components(edges, "l", "r").collect()}
    assert len({v for k, v in got.items() if k.startswith("a")}) == 1 and got["x"] == got["z"] == "x" and len(got) == 34


def test_lattices_and_missing(spark):
    items = spark.createDataFrame(
        [("k", "m2", "f", Decimal(2), Decimal(3), None, False), ("k", "m2", "f", Decimal(1), Decimal(3), Decimal(3), False), ("n", "m2", "f", None, Decimal(3), None, False), ("u", "m2", "f", Decimal(1), Decimal(1), Decimal(1), False), ("u", "m", "f", Decimal(1), Decimal(1), Decimal(1), False)],
        "key string, unit string, feature string, quantity decimal(18,6), unit_price decimal(18,6), amount decimal(18,6), is_deduction boolean",
    )
    got = {r.key: r for r in aggregate.cumulate(items, ["key"]).collect()}
    assert got["k"].total == Decimal(9) and got["k"].source == "mixed" and got["k"].status == "incomplete"
    assert got["n"].total is None and got["n"].quantity is None and got["n"].status == "incomplete"  # missing is not zero
    assert got["u"].status == "incomparable" and got["u"].quantity is None
    median = aggregate.exact_median(items, ["unit"], "unit_price").filter("unit = 'm2'").first()
    assert median.median == 3.0 and median.n == 4


def test_ledger(spark):
    rows = spark.createDataFrame(
        [("upward", "s", 1, "incremental", "a", "", "m", Decimal(2)), ("upward", "s", 2, "incremental", "a", "", "m", Decimal(3)), ("downward", "s", 1, "cumulative", "a", "", "m", Decimal(4)), ("downward", "s", 2, "cumulative", "a", "", "m", Decimal(6)), ("upward", "x", 1, "incremental", "b", "", "m", Decimal(1)), ("upward", "x", 2, "cumulative", "b", "", "m", Decimal(1))],
        "direction string, scope string, period_no int, mode string, name string, code string, unit string, quantity decimal(18,6)",
    ).withColumn("feature", F.lit(None).cast("string"))
    book = ledger.rollup(rows, ["direction", "scope"])
    got = {(r.direction, r.scope): r.quantity for r in book.collect()}
    assert got == {("upward", "s"): Decimal(5), ("downward", "s"): Decimal(6)}  # the scope in conflict is left out
    assert [r.verdict for r in ledger.control(book, "upward", "downward", "direction", ["scope"]).collect()] == ["FAIL"]


def test_lineage(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    a, b = lineage.table_digest(df, "t"), lineage.table_digest(df.orderBy(F.desc("x")).repartition(3), "t")
    assert a.first() == b.first()
    other = lineage.table_digest(df.limit(1), "t")
    assert lineage.drift(a, other).first().state == "changed" and lineage.run_signature(a).first().n_components == 1


def test_control_total_is_never_guessed(spark):
    cells = spark.createDataFrame([("s", 1, 1, "清单编码"), ("s", 1, 2, "清单名称"), ("s", 1, 3, "合价"), ("s", 2, 1, "1"), ("s", 2, 2, "w"), ("s", 2, 3, "5"), ("s", 3, 2, "合计"), ("s", 3, 3, "5"), ("s", 4, 2, "总计"), ("s", 4, 3, "7")], "sheet_id string, row int, col int, value string")
    assert verify.path_control(cells).first().c_total is None  # two grand totals


def test_token_set_ratio():
    s = token_set_ratio(pd.Series(["a b c", "abc", "x y", None]), pd.Series(["c b a", "abd", "p q", "x"]))
    assert s[0] == 100.0 and 60 < s[1] < 70 and s[2] < 40 and s[3] == 0.0


@pytest.mark.parametrize("mode", ["append"])
def test_streams(spark, small_data, mode):
    stream = events.event_stream(spark, f"{small_data}/events.parquet")
    done = events.run_to_end(events.tumbling(stream), mode)
    batch = spark.read.parquet(f"{small_data}/events.parquet").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert 0 < done.count() <= batch.count()
    users = events.run_to_end(events.running_balance(events.event_stream(spark, f"{small_data}/events.parquet")), "update")
    assert users.groupBy("user_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small_data}/events.parquet").count()
    assert events.run_to_end(events.sessions(events.event_stream(spark, f"{small_data}/events.parquet")), "append").count() > 0


def test_a_failing_rule_takes_no_other_with_it(spark):
    rows = spark.createDataFrame([(1, -2.0), (2, 3.0)], "id int, q double")
    good = rulebook.Rule("good", ("items",), lambda t: rulebook.finding(t.filter("q < 0"), "negative", "high", "id"))
    absent = rulebook.Rule("absent", ("cells",), good.find)
    broken = rulebook.Rule("broken", ("items",), lambda t: t.filter("no_such_column > 1"))
    late = rulebook.Rule("late", ("items",), lambda t: rulebook.finding(t.filter(F.raise_error(F.lit("x")).isNull()), "x", "low", "id"))
    off = rulebook.Rule("off", ("items",), good.find)
    found, coverage = rulebook.run(spark, [broken, good, absent, late, off], {"items": rows}, frozenset({"off"}))
    assert [(r.rule_id, r.subject) for r in found.collect()] == [("negative", "1")]
    assert {r.rule: (r.status, r.n_findings) for r in coverage.collect()} == {"good": ("executed", 1), "broken": ("failed", None), "absent": ("skipped", None), "late": ("failed", None), "off": ("skipped", None)}
    assert rulebook.coverage_status(coverage).first().status == "failed"
    empty, coverage = rulebook.run(spark, [good], {"items": rows.limit(0)})
    assert empty.count() == 0 and rulebook.coverage_status(coverage).first().status == "complete"


def test_cell_and_text_predicates(spark):
    assert column(spark, ["(1,200)", "¥3.5", "12%", "abc", None, "1.2.3"], texts.looks_numeric, ) == [True, True, True, False, False, False]
    assert column(spark, ["01-02", "A1", "abc", "中1", None], texts.looks_code) == [True, True, False, False, False]
    assert column(spark, ["税金", "税金（9%）", "税金调整", None], texts.tax_only) == [True, True, False, False]
    assert column(spark, ["一", "（十二）", "1.1.2", "第二部分", "其中", "010101011001", "1", "墙", None], texts.level_label) == [True] * 5 + [False] * 4
    assert column(spark, ["3号楼", "1-3号楼", "1号楼及2号楼", "1号楼和2-4号楼", "1-2号楼、4~5号楼", "", None], lambda c: texts.building_verdict(texts.building_groups(F.coalesce(c, F.lit(""))))["status"]) == ["accepted", "combined", "conflict", "mixed sources", "conflict", "unconfirmed", "unconfirmed"]
    assert column(spark, ["m³", "M3", " 米 ", "T", "t", None], units.rule_unit) == ["m3", "m3", "m", "t", "t", ""]
    assert column(spark, ["M³", "M3", "米"], units.radar_unit) == ["m3", "m3", "米"]
    assert column(spark, ["a" * 64, "x", None], lambda c: texts.sheet_row_id(c, F.lit(' S"1 '), F.lit(3))) == ["sha256:" + "a" * 64 + '|sheet:"S\\"1"|row:3', None, None]
    pairs = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (4.0, 5.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in pairs.select(numbers.difference_rate(F.col("a"), F.col("b"))).collect()] == [0.0, None, 0.25, None]


def _sheet(spark, rows):
    return spark.createDataFrame([("s", i + 1, j + 1, v) for i, row in enumerate(rows) for j, v in enumerate(row) if v is not None], "sheet_id string, row int, col int, value string")


TWO_ROWS = [
    ["结算书"],
    ["0", "1", "2"],
    ["编码", "名称", "单位", "工程量", "金额（元）"],
    [None, None, None, None, "综合单价", "合价"],
    ["一", "土建"],
    ["01", "墙", "m2", "2", "3", "6"],
    ["02", "柱", "m3", "二", "3", "9"],
    ["编码", "名称", "单位", "工程量", "综合单价", "合价"],
    [None, "扣款项目"],
    ["03", "罚金", "项", "1", "5", "5"],
    [None, "小计", None, None, None, "20"],
    ["04", "梁", "m3", "1", "7", "7"],
    [None, "合计", None, None, None, "27"],
    [None, None, None, None, None, "27"],
]


def test_header_of_two_rows_and_all_classes(spark):
    cells = _sheet(spark, TWO_ROWS)
    h = grid.detect_headers(cells).first()
    assert (h.header_row, h.header_last) == (3, 4) and h.col_map == {"code": 1, "name": 2, "unit": 3, "quantity": 4, "unit_price": 5, "amount": 6}
    got = {r.row: (r["class"], r.unparsed) for r in grid.extract_rows(cells).collect()}
    kinds = ["group", "detail", "detail", "repeated_header", "group", "deduction", "subtotal", "detail", "grand_total", "trailing"]
    assert [got[i][0] for i in range(5, 15)] == kinds and [i for i in got if got[i][1]] == [7]
    assert {r.row: r["class"] for r in grid.rows_above(cells).collect()} == {1: "title", 2: "figures_above"}
    proof = grid.coverage(cells, grid.extract_rows(cells)).first()
    assert (proof.n_rows, proof.n_detail, proof.n_deduction, proof.n_unparsed, proof.proof) == (12, 3, 1, 1, "doubtful")
    agree = verify.control_candidates(cells).first()
    assert agree.by_class == agree.by_words == [11, 13] and agree.agree


def test_ambiguous_header_costs_confidence(spark):
    one = grid.detect_headers(_sheet(spark, [["编码", "名称", "单位", "合价"]])).first()
    two = grid.detect_headers(_sheet(spark, [["编码", "名称", "单位", "合价", "金额"]])).first()
    assert one.confidence == 1.0 and not one.needs_review and two.col_map["amount"] == 4
    weak = grid.detect_headers(_sheet(spark, [["编码", "名称", "名称", "单位"]])).first()
    assert weak.needs_review
    assert grid.detect_headers(_sheet(spark, [["编码", "墙"]])).count() == 0


def test_contexts_and_cycles(spark):
    rows = [(1, "confirmed", None), (2, "confirmed", 1), (3, "draft", 2), (4, "confirmed", 6), (5, "confirmed", 4), (6, "confirmed", 5), (7, "confirmed", 6)]
    c = spark.createDataFrame([(*r, "k") for r in rows], "id bigint, status string, supersedes_id bigint, k string")
    assert {r.id for r in ledger.effective_contexts(c).collect()} == {2, 7}
    assert {r.id for r in ledger.supersede_cycles(c).collect()} == {4, 5, 6}
    assert ledger.supersede_cycles(c.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, k string")
    assert {r.id: r.conflict for r in ledger.identity_conflicts(twice, ["k"]).collect()} == {1: True, 2: True, 3: False}


def test_two_ceilings_by_severity(spark):
    side = lambda rows: spark.createDataFrame(rows, "code string, quantity decimal(18,2), n int")
    used = side([("a", Decimal(5), 1), ("b", Decimal(5), 1), ("c", Decimal(5), 1), ("d", None, 1), ("e", Decimal(1), 1)])
    contract = side([("a", Decimal(9), 1), ("b", Decimal(4), 1), ("c", Decimal(9), 2), ("d", Decimal(9), 1), ("f", Decimal(9), 1)])
    settled = side([("a", Decimal(9), 1), ("b", Decimal(9), 1), ("c", Decimal(9), 1), ("d", Decimal(9), 1), ("e", Decimal(9), 1), ("f", Decimal(9), 1)])
    got = {r.code: (r.worst, r.reason) for r in ledger.two_ceilings(used, contract, settled, used.filter("code = 'e'"), ["code"]).collect()}
    assert got == {"a": ("PASS", "within both ceilings"), "b": ("FAIL", "ceiling exceeded"), "c": ("CONTROL_CONFLICT", "several ceilings"), "d": ("PENDING", "quantity missing"), "e": ("PENDING", "no contract ceiling"), "f": ("PASS", "within both ceilings")}


def test_greedy_pairs_against_one_pass(spark):
    import random

    rng = random.Random(6)
    pairs = sorted({tuple(sorted((rng.randrange(40), rng.randrange(40)))) for _ in range(90)})
    used, want = set(), set()
    for a, b in pairs:
        if a != b and a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    rows = spark.createDataFrame([(b, a) if i % 3 == 0 else (a, b) for i, (a, b) in enumerate(pairs)] + [pairs[0]], "x int, y int")
    assert {tuple(r) for r in pairing.greedy_pairs(rows, "x", "y").collect()} == want
    assert pairing.greedy_pairs(rows.limit(0), "x", "y").count() == 0


def test_template_recommendations(spark):
    sheets = spark.createDataFrame([(1, ["编码", "名称", " 单位"], ["code", "name", "unit"]), (2, ["x"], []), (3, [], [])], "sheet_id int, labels array<string>, fields array<string>")
    kept = spark.createDataFrame([(7, ["名称", "编码", "单位"], ["code", "name", "unit"]), (8, ["名称"], ["name"]), (9, ["y"], ["name"])], "template_id int, labels array<string>, fields array<string>")
    got = {(r.sheet_id, r.template_id): (r.score, r.exact, r.place) for r in grid.recommend_templates(sheets, kept, least=0.1).collect()}
    assert got == {(1, 7): (1.0, True, 1), (1, 8): (0.3333, False, 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_successive_pairs_against_progressive(spark, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    rows = [(f"r{i}", pick("u", "d"), pick(1, 2, 2, 3, 3, 5, 6, None), pick("", " ", None, *map(str, range(25))), pick("a", "b", " b", "c", "d", "", None), pick("x", "y", "z"), pick("m", "kg", "t", "", None)) for i in range(260)]
    df = spark.createDataFrame([(*r, int(r[3]) if (r[3] or "").strip() else 99) for r in rows], "id string, direction string, period int, code string, name string, feature string, unit string, near int")
    side = lambda shift: df.filter("period is not null").withColumn("pair", F.concat_ws(":", "direction", F.col("period") - shift))
    passes = [("1", ("code",)), ("2", ("name", "feature", "unit")), ("3", ("name", "feature"))]
    want = {tuple(r) for r in pairing.progressive_pairs(side(0), side(1), [(n, pairing.composite_key("pair", *f)) for n, f in passes]).collect()}
    assert {w[2] for w in want} == {"1", "2", "3"}
    found, steps, later = pairing.successive_pairs(df.withColumn("tag", F.col("id")), "direction", "period", "code", ["name", "feature"], "unit", ["tag"], near="near")
    found = found.select("id", "_left", "_right", "_next_tag").collect()
    pairs = [(r.left.id, r.right.id) for r in later.collect()]
    assert {(r.id, r._next_tag) for r in found if r._left == 1} == {w[:2] for w in want if w[2] == "1"}
    assert len(pairs) == len(set(pairs)) and set(pairs) == {w[:2] for w in want if w[2] != "1"}
    assert {(r.id, str(r._left)) for r in found if r._left} == {(w[0], w[2]) for w in want}
    assert {(r.id, str(r._right)) for r in found if r._right} == {(w[1], w[2]) for w in want}
    there = {(r[1], r[2]) for r in rows if r[2]}
    assert {tuple(r) for r in steps.collect()} == {(d, p, (d, p + 1) in there, (d, p - 1) in there) for d, p in there}


@pytest.mark.parametrize("name", ["period_differences", "difference_summary"])
def test_differences_keep_no_copy_of_the_rows(spark, small_data, monkeypatch, name):
    """Kept rows are written uncompressed; a copy of all rows on either side took more disk than the tables."""
    kept = []

    def counted(df):
        out = cut_lineage(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(pairing, "cut_lineage", counted)
    monkeypatch.setattr(control, "cut_lineage", counted)
    assert control.QUERIES[name](spark, small_data).count() > 0
    assert kept and sum(kept) < boq(spark, small_data).count() / 2


def test_difference_summary_leaves_no_shuffle_files(spark, small_data):
    """The files of the first job, which counts keys, must not lie beside those of the second; nor are ids moved that it has no use for."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {p: p.stat().st_size for f in folders for p in Path(f.getPath()).glob("*/shuffle_*.data")}
    spark._jvm.System.gc()
    time.sleep(1)
    before = files()
    summary = control.difference_summary(spark, small_data)
    left = lambda: sum(n for p, n in files().items() if p not in before)
    until = time.time() + 10
    while left() > 1000 and time.time() < until:
        time.sleep(0.2)
    assert left() <= 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" in plan and "l_orderkey" not in plan
