"""Joins that pair records one to one and refuse to fan out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantora.session import cut_lineage, shuffles_dropped


def composite_key(*fields: str) -> Column:
    """One text of all fields, trimmed; null if any is missing or blank."""
    parts = [F.nullif(F.trim(F.col(f).cast("string")), F.lit("")) for f in fields]
    return F.when(F.least(*[p.isNotNull() for p in parts]) if len(parts) > 1 else parts[0].isNotNull(), F.concat_ws("\u0001", *parts))


def classify_keys(left: DataFrame, right: DataFrame, fields: list[str], left_id: str, right_id: str) -> DataFrame:
    """side, id and class of every record of both sides.

    In order: ``null_key``, ``duplicate`` (own side), ``blocked`` (the other side has
    duplicates), ``only`` (no counterpart), ``matched``; matched records carry their
    partner. Group sizes are counted before the join, so no key ever fans out.
    """
    side = lambda df, name, rid: df.select(F.lit(name).alias("side"), F.col(rid).cast("string").alias("id"), composite_key(*fields).alias("_k"))
    both = side(left, "left", left_id).unionByName(side(right, "right", right_id))
    counts = both.filter(F.col("_k").isNotNull()).groupBy("_k").agg(
        F.count_if(F.col("side") == "left").alias("_l"), F.count_if(F.col("side") == "right").alias("_r"), F.min(F.when(F.col("side") == "left", F.col("id"))).alias("_li"), F.min(F.when(F.col("side") == "right", F.col("id"))).alias("_ri")
    )
    own = F.when(F.col("side") == "left", F.col("_l")).otherwise(F.col("_r"))
    other = F.when(F.col("side") == "left", F.col("_r")).otherwise(F.col("_l"))
    kind = F.when(F.col("_k").isNull(), "null_key").when(own > 1, "duplicate").when(other > 1, "blocked").when(other == 0, "only").otherwise("matched")
    partner = F.when(F.col("side") == "left", F.col("_ri")).otherwise(F.col("_li"))
    return both.join(counts, "_k", "left").select("side", "id", kind.alias("class"), F.when(kind == "matched", partner).alias("partner"))


def unique_pairs(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """(left_id, right_id) of the keys that are unique on both sides; sides have ``id``."""
    single = lambda df, name: df.withColumn("_k", key).filter(F.col("_k").isNotNull()).groupBy("_k").agg(F.count("*").alias("_n"), F.min("id").alias(name)).filter("_n = 1").drop("_n")
    return single(left, "left_id").join(single(right, "right_id"), "_k").drop("_k")


def progressive_pairs(left: DataFrame, right: DataFrame, keys: list[tuple[str, Column]]) -> DataFrame:
    """left_id, right_id and the pass that paired them: each pass pairs what is unique, the rest goes on.

    Both sides are read once, reduced to their id and keys and kept; every pass reads
    what is kept and is kept itself, so that no pass computes an earlier one again.
    """
    narrow = lambda df: cut_lineage(df.select("id", *[key.alias(f"_k{i}") for i, (_, key) in enumerate(keys)]))
    left, right = narrow(left), narrow(right)
    found = None
    for i, (name, _) in enumerate(keys):
        pairs = cut_lineage(unique_pairs(left, right, F.col(f"_k{i}")).withColumn("pass", F.lit(name)))
        found = pairs if found is None else found.unionByName(pairs)
        if i + 1 < len(keys):
            left = cut_lineage(left.join(pairs.select(F.col("left_id").alias("id")), "id", "left_anti"))
            right = cut_lineage(right.join(pairs.select(F.col("right_id").alias("id")), "id", "left_anti"))
    return found


def successive_pairs(rows: DataFrame, within: str, at: str, code: str, texts: list[str], last: str, carried: list[str], near: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows of successive steps paired in three passes: by ``code``, by ``texts`` and ``last``, by ``texts``.

    A row stands once in ``rows``, for both its pairs of steps: with step ``at`` + 1 it is
    the earlier (left) side, with ``at`` - 1 the later (right) one. Each pass pairs the
    keys that are unique on both sides, as :func:`progressive_pairs` does, which wants
    every row twice. ``near`` has one value for all rows of a code; rows that are
    partitioned by it are not moved again: later passes move counts per key, and the
    rows that they pair.

    Returns the rows with ``_left`` and ``_right``, the pass (1 to 3) that paired the
    row on that side, and the carried fields of its partner of pass 1 as ``_next_*``;
    the steps with their neighbours, ``has_next`` and ``has_previous``; and the pairs
    of passes 2 and 3 (``left`` and ``right``: structs of ``at``, ``id`` and the
    carried fields), None if there are none.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    is_ = lambda c, n: F.coalesce(c == n, F.lit(False))
    keys = [f"_t{i}" for i in range(len(texts))]
    rows = rows.filter(F.col(at).isNotNull()).withColumns({"_code": blank(code), "_last": blank(last)} | {k: blank(c) for k, c in zip(keys, texts, strict=True)})

    # Pass 1. In the order of steps, a row is unique if it has no neighbour of its own step.
    w = Window.partitionBy(near, within, "_code").orderBy(at)
    rows = rows.withColumns({"_a1": F.lead(at, 1).over(w), "_a2": F.lead(at, 2).over(w), "_b1": F.lag(at, 1).over(w), "_b2": F.lag(at, 2).over(w)} | {f"_next_{c}": F.lead(c, 1).over(w) for c in carried})
    coded, here = F.col("_code").isNotNull(), F.col(at)
    left = coded & is_(F.col("_a1"), here + 1) & ~is_(F.col("_a2"), here + 1) & ~is_(F.col("_b1"), here)
    right = coded & is_(F.col("_b1"), here - 1) & ~is_(F.col("_b2"), here - 1) & ~is_(F.col("_a1"), here)
    rows = rows.withColumns({"_l1": left, "_r1": right}).drop("_a1", "_a2", "_b1", "_b2")

    # Passes 2 and 3: what is left on either side, counted by key; where it is one row, the maximum is its own value.
    # Counted where the rows are at first, then moved once, to where the windows want them.
    key = (within, at, *keys, "_last")
    open_ = {"_l": ~F.col("_l1"), "_r": ~F.col("_r1")}
    counts = rows.groupBy(near, *key).agg(*[F.count_if(c).alias(s) for s, c in open_.items()]).repartition(within, *keys)
    counts = counts.groupBy(*key).agg(*[F.sum(s).alias(s) for s in open_], *[F.max(F.when(F.col(s) > 0, F.col(near))).alias(f"{s}n") for s in open_])
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    full = named & F.col("_last").isNotNull()
    w = Window.partitionBy(within, *keys, "_last").orderBy(at)
    groups = counts.withColumns({"_rr": F.when(F.lead(at).over(w) == here + 1, F.lead("_r").over(w)), "_ll": F.when(F.lag(at).over(w) == here - 1, F.lag("_l").over(w))})
    groups = groups.withColumns({"_l2": full & is_(F.col("_l"), 1) & is_(F.col("_rr"), 1), "_r2": full & is_(F.col("_r"), 1) & is_(F.col("_ll"), 1)})
    groups = groups.withColumns({"_l": F.col("_l") - F.col("_l2").cast("int"), "_r": F.col("_r") - F.col("_r2").cast("int")})
    w = Window.partitionBy(within, *keys).orderBy(at)
    total = lambda c, n: F.sum(c).over(w.rangeBetween(n, n))
    groups = groups.withColumns({"_l0": total("_l", 0), "_r0": total("_r", 0), "_rr": total("_r", 1), "_ll": total("_l", -1)})
    groups = groups.withColumns({"_l3": named & is_(F.col("_l"), 1) & is_(F.col("_l0"), 1) & is_(F.col("_rr"), 1), "_r3": named & is_(F.col("_r"), 1) & is_(F.col("_r0"), 1) & is_(F.col("_ll"), 1)})
    entry = lambda s: F.when(F.col(f"{s}2") | F.col(f"{s}3"), F.struct(F.lit(s).alias("side"), F.when(F.col(f"{s}2"), 2).otherwise(3).alias("pass"), F.col(f"{s}n").alias("near")))
    unique = groups.select(*key, F.explode(F.array(entry("_l"), entry("_r"))).alias("e")).filter("e is not null").select(*key, "e.*")
    # Both branches need every column of the counts, so that they share one exchange.
    steps = counts.groupBy(within, at).agg(F.max(F.coalesce("_ln", "_rn")).alias("near"), F.sum(F.col("_l") + F.col("_r")).alias("_n"), F.count("_last").alias("_m"))
    with shuffles_dropped(rows.sparkSession):
        kept = cut_lineage(unique.unionByName(steps, allowMissingColumns=True))
    w = Window.partitionBy(within).orderBy(at)
    steps = kept.filter("side is null").select(within, at, is_(F.lead(at).over(w), here + 1).alias("has_next"), is_(F.lag(at).over(w), here - 1).alias("has_previous"))
    unique = kept.filter("side is not null")
    if unique.isEmpty():
        return rows.withColumns({"_left": F.when(F.col("_l1"), 1), "_right": F.when(F.col("_r1"), 1)}), steps, None

    # Joined by ``near`` alone, by which the rows are partitioned and sorted; no key fans out.
    unique = unique.groupBy(F.col("near").alias("_near")).agg(F.collect_list(F.struct(*key, "side", "pass")).alias("_unique"))
    rows = rows.join(unique, F.col(near) == F.col("_near"), "left")

    def later(side: str) -> Column:
        def own(x: Column) -> Column:
            same = x["side"] == side
            for c in key:
                same = same & x[c].eqNullSafe(F.col(c))
            return same

        return F.get(F.filter("_unique", own), F.lit(0))["pass"]

    rows = rows.withColumns({"_left": F.when(F.col("_l1"), 1).otherwise(later("_l")), "_right": F.when(F.col("_r1"), 1).otherwise(later("_r"))})
    one = lambda s, shift: F.when(F.col(s) > 1, F.struct(F.lit(s).alias("side"), F.col(s).alias("pass"), (here - shift).alias("pair"), F.when(F.col(s) == 2, F.col("_last")).alias("last")))
    sides = rows.select(within, *keys, F.struct(at, "id", *carried).alias("row"), F.explode(F.array(one("_left", 0), one("_right", 1))).alias("s")).filter("s is not null").select(within, *keys, "s.*", "row")
    pairs = sides.groupBy(within, *keys, "pass", "pair", "last").agg(*[F.min(F.when(F.col("side") == s, F.col("row"))).alias(s[1:]) for s in ("_left", "_right")])
    return rows, steps, pairs.select(within, "left", "right")


def positional_pairs(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of equal key paired by their position; ``ambiguous`` where a key repeats, leftovers have no partner."""
    w, g = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    number = lambda df, s: df.select(*keys, F.col("id").alias(f"{s}_id"), F.row_number().over(w).alias("position"), F.count("*").over(g).alias(f"_{s}"))
    joined = number(left, "left").join(number(right, "right"), [*keys, "position"], "full")
    several = (F.coalesce("_left", F.lit(0)) > 1) | (F.coalesce("_right", F.lit(0)) > 1)
    return joined.select(*keys, "position", "left_id", "right_id", several.alias("ambiguous"))


def greedy_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs that a pass in the order of (left, right) takes, where a record is in one taken pair at most.

    ``left`` sorts before ``right`` in every pair. A pair that comes before all others
    of both its records is taken in any case; its records' other pairs go, and the
    next round looks at the rest. Each round is two aggregates; the first pair of all
    is always taken, so the rounds end.
    """
    rest = cut_lineage(pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).filter("a < b").distinct())
    taken = None
    while not rest.isEmpty():
        ends = rest.select(F.explode(F.array("a", "b")).alias("node"), F.struct("a", "b").alias("pair")).groupBy("node").agg(F.min("pair").alias("first"))
        ends = cut_lineage(ends)
        agreed = ends.select("node", "first.a", "first.b").groupBy("a", "b").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b")
        agreed = cut_lineage(agreed)
        taken = agreed if taken is None else taken.unionByName(agreed)
        used = agreed.select(F.explode(F.array("a", "b")).alias("node"))
        rest = cut_lineage(rest.join(used.withColumnRenamed("node", "a"), "a", "left_anti").join(used.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
    return (rest if taken is None else taken).toDF(left, right)
