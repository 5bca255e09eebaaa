"""Orphan references, base units, snapshot changes: semantics and defined cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantora.operators import snapshots
from quantora.operators.adjacent import previous_row
from quantora.operators.measures import needs_conversion, to_base_units
from quantora.operators.orphans import Child, Parent, classify_references, find_orphans, orphan_report

T = lambda day: dt.datetime(2024, 1, day)


def _specs(spark, children, parents, extra=""):
    child = spark.createDataFrame(children, f"id bigint, ref bigint, at timestamp, place bigint{extra}")
    parent = spark.createDataFrame(parents, "id bigint, came timestamp, gone timestamp, _key string, reason string")
    return [Child("c", child, "id", "at", {"ref": "p"}, {"_place": F.col("place")})], [Parent("p", parent, "id", "came", "gone")]


def test_orphan_reasons(spark):
    children = [(1, 10, T(5), 7), (2, 11, T(5), 7), (3, 12, T(5), 7), (4, 99, T(5), 8), (5, None, T(5), 8), (6, 13, None, 8), (4, 99, T(5), 8), (7, 14, T(5), None)]
    parents = [(10, T(1), None, "x", "y"), (11, T(1), T(2), None, None), (12, T(9), None, None, None), (13, T(9), None, None, None), (None, T(1), None, None, None), (14, T(1), T(3), None, None), (14, T(4), None, None, None)]
    c, p = _specs(spark, children, parents)
    found = {(r.record_id, r.reason) for r in find_orphans(c, p).collect()}
    assert found == {(2, "deleted"), (3, "late"), (4, "missing")}
    assert find_orphans(c, p).count() == 3  # a repeated record is reported once
    assert classify_references(c, p).count() == 7  # null references give no row
    report = {r.period_id: (r.n_references, r.n_missing, r.n_deleted, r.n_late) for r in orphan_report(c, p, "_place").collect()}
    assert report == {7: (3, 0, 1, 1), 8: (3, 2, 0, 0), None: (1, 0, 0, 0)}


def test_orphans_of_empty_tables(spark):
    c, p = _specs(spark, [(1, 10, T(1), 1)], [])
    assert [r.reason for r in find_orphans(c, p).collect()] == ["missing"]
    c, p = _specs(spark, [], [(1, T(1), None, None, None)])
    assert find_orphans(c, p).count() == 0


def test_hot_reference_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("ref"), F.lit(T(2)).alias("at"))
    parent = spark.createDataFrame([(5, T(1), T(2))], "id bigint, came timestamp, gone timestamp")
    found = find_orphans([Child("c", rows, "id", "at", {"ref": "p"})], [Parent("p", parent, "id", "came", "gone")])
    counts = {r.reason: r.n for r in found.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert counts == {"deleted": 1001, "missing": 1999}


UNITS = [
    ("12.5", "kg", None, "t", "0.0125", "unit", True),
    ("2", "100m2", None, "m2", "200", "unit", True),
    ("2", "M2", None, "m2", "2", "unit", False),
    ("2", "ｍ２", None, "m2", "2", "unit", False),
    ("2", "М3", None, "m3", "2", "unit", False),
    ("1,234.5 m", None, None, "m", "1234.5", "quantity", True),
    ("约(3)吨", "", None, "t", "-3", "quantity", True),
    ("4.5", " ", "高度80m内（计量单位：百平方米）", "m2", "450", "feature", True),
    ("4.5", None, "按亩计量", "m2", "3000", "feature", True),
    ("4.5", None, "高度80m内", None, None, None, False),
    ("待核", "kg", None, "t", None, "unit", False),
    (None, "kg", None, "t", None, "unit", False),
    ("3", "台", "高度5m", None, None, "unit", False),
    ("3", "平方采", None, "m2", "3", "unit", False),
    ("1.2.3", "kg", None, "t", None, "unit", False),
    ("7", "升​", None, "m3", "0.007", "unit", True),
]


def test_base_units(spark):
    rows = spark.createDataFrame([(i, q, u, f, "x", 1) for i, (q, u, f, *_) in enumerate(UNITS)], "id bigint, quantity string, unit string, feature string, base_unit string, spelling int")
    out = {r.record_id: r for r in to_base_units(rows).collect()}
    found = {r.record_id for r in needs_conversion(to_base_units(rows)).collect()}
    assert len(out) == len(UNITS)
    for i, (q, u, f, base, value, where, case) in enumerate(UNITS):
        assert (out[i].base_unit, out[i].stated_in) == (base, where), (i, q, u, f, out[i])
        got = out[i].base_quantity
        assert (got is None) if value is None else abs(float(got) - float(value)) < 1e-3, (i, got)
        assert (i in found) == case, (i, q, u, f)
    assert to_base_units(rows.limit(0)).count() == 0


def _brute(versions, items):
    by = {}
    for row in sorted(items):
        _, v, k, o, price, amount = row
        by.setdefault(v, {}).setdefault((k, o), (price or None, amount or None))
    out = set()
    per = {}
    for i, p, n, _ in sorted(versions):
        per.setdefault(p, {}).setdefault(n, i)
    for p, numbered in per.items():
        order = sorted(numbered)
        for a, b in zip(order, order[1:], strict=False):
            x, y = by.get(numbered[a], {}), by.get(numbered[b], {})
            for key in x.keys() | y.keys():
                kind = "added" if key not in x else "removed" if key not in y else "changed" if x[key] != y[key] else None
                if kind:
                    out.add((p, b, *key, kind))
    return out


@pytest.mark.parametrize("cells, rounds", [(0.5, 3), (0.02, 1), (0.02, 0)])
def test_snapshots_against_brute_force(spark, cells, rounds):
    rng = random.Random(3)
    versions = [(i, i % 5, i // 5 * 2, f"s{i}") for i in range(20)] + [(0, 0, 0, "s0")]
    items, n = [], 0
    for i in range(20):
        for k in range(rng.randrange(0, 120)):
            if rng.random() < 0.8:
                items.append((n, i, f"k{k}", 1 + k % 2, rng.choice(["1", "2", "", None]), rng.choice(["5", "6"])))
                n += 1
    items.append(items[3])  # delivered twice
    v = spark.createDataFrame(versions, "id bigint, project_id bigint, version_no int, snapshot_sha256 string")
    t = spark.createDataFrame(items, "id bigint, version_id bigint, identity_key string, occurrence int, unit_price string, amount string").withColumn("pair_id", F.lit(1)).withColumn("sign", F.lit(2))
    got = {tuple(r) for r in snapshots.snapshot_changes(v, t, bucket_rows=16, cells_per_row=cells, rounds=rounds).collect()}
    assert got == _brute(versions, items)


def test_snapshot_notation_and_digests(spark):
    v = spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 5, "b"), (3, 1, 6, "b"), (4, None, 1, "c"), (5, 2, 1, "d")], "id bigint, project_id bigint, version_no int, snapshot_sha256 string")
    items = [(1, 1, "k", 1, "1,200.50", ""), (2, 2, "k", 1, "¥1200.5", None), (3, 2, "m", 1, "1", "2"), (4, 3, "z", 1, "9", "9"), (5, 2, None, 1, "1", "1"), (6, None, "k", 1, "1", "1")]
    t = spark.createDataFrame(items, "id bigint, version_id bigint, identity_key string, occurrence int, unit_price string, amount string")
    assert {tuple(r) for r in snapshots.snapshot_changes(v, t).collect()} == {(1, 5, "m", 1, "added")}
    assert snapshots.snapshot_changes(v.limit(0), t).count() == 0
    assert {r.change_kind for r in snapshots.snapshot_changes(v, t.limit(0)).collect()} == set()


def test_peeling_fails_honestly():
    assert snapshots.peel(8, [(0, 2, 1, 1, 1, 1)], 0) is None
    assert snapshots.peel(8, [], 0) == []


def test_previous_row_across_blocks(spark):
    rows = spark.createDataFrame([(k, n) for k in "ab" for n in (1, 5, 1023, 1024, 5000)], "k string, n int")
    got = {(r.k, r.n): r.prev_n for r in previous_row(rows, "k", "n", ["n"]).collect()}
    assert got["a", 1] is None and got["a", 1024] == 1023 and got["b", 5000] == 1024 and got["b", 5] == 1


def test_figures_with_text_around_them(spark):
    texts = ["quantity: 12.5 m2", "12.5，m2", "12.5.", "12.5.3", "1,234,5"]
    rows = to_base_units(spark.createDataFrame([(i, t, "m2", None) for i, t in enumerate(texts)], "id int, quantity string, unit string, feature string"))
    assert {r.record_id: r.base_quantity and float(r.base_quantity) for r in rows.collect()} == {0: 12.5, 1: 12.5, 2: 12.5, 3: None, 4: None}
    bare = to_base_units(spark.createDataFrame([(0, "12.5，m2", None, None)], "id int, quantity string, unit string, feature string")).first()
    assert bare.spelling == "m2" and bare.status == "converted"
