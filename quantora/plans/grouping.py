"""Grouping of like items: by code, merged through shared names, uncoded rows attached, fuzzy names scored."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.operators import pairing
from quantora.operators.components import connected_components
from quantora.plans.domain import boq, boq_and, over_boq
from quantora.session import cut_lineage
from quantora.sources.tables import table


def match_name(c: Column) -> Column:
    """A name for matching: lower case, half-width, without brackets, punctuation and spaces."""
    wide, plain = "（）【】，。；：、　", "()[],.;:, "
    return F.regexp_replace(F.lower(F.translate(c, wide, plain)), "[()\\[\\],.;:\\s_/\\-]", "")


def code_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one code per direction with the level that their names, units and features allow.

    The last that applies wins: confirmed, probable (several names), incomparable (units, then features), pending (no unit or name).
    """
    rows = boq(spark, d).filter("code <> ''")
    g = rows.groupBy("direction", "code").agg(
        F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_distinct(F.when(F.col("unit").isin("t", "kg"), "t").otherwise(F.col("unit"))).alias("units"),
        F.count_distinct("feature").alias("features"), F.count_if(F.coalesce("unit", F.lit("")) == "").alias("_nu"), F.count_if(F.coalesce("name", F.lit("")) == "").alias("_nn"),
    )
    level = F.when((F.col("_nu") > 0) | (F.col("_nn") > 0), "pending_data").when((F.col("units") > 1) | (F.col("features") > 1), "incomparable").when(F.col("names") > 1, "probable").otherwise("confirmed")
    return g.select("direction", "code", "n", "names", "units", "features", level.alias("level"))


def name_code_components(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the items merged over the names they share, chain by chain: connected components, with their codes and names."""
    named = boq(spark, d).filter("code <> ''").select(F.concat(F.lit("c:"), "code").alias("code"), F.concat(F.lit("n:"), match_name(F.col("name"))).alias("name"))
    comp = connected_components(named, "code", "name")
    return comp.groupBy("component").agg(F.count_if(F.col("node").startswith("c:")).alias("n_codes"), F.count_if(F.col("node").startswith("n:")).alias("n_names"))


def uncoded_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Rows without code, attached to the one code that bears their name in the direction, or left alone."""
    rows = boq(spark, d).withColumn("_k", match_name(F.col("name")))
    hosts = rows.filter("code <> ''").groupBy("direction", "_k").agg(F.count_distinct("code").alias("n_hosts"), F.min("code").alias("host"))
    open_ = rows.filter("code = ''").select("rid", "direction", "_k").join(hosts, ["direction", "_k"], "left")
    return open_.select("rid", F.when(F.col("n_hosts") == 1, F.col("host")).alias("host"), F.coalesce("n_hosts", F.lit(0)).alias("n_hosts"))


def duplicate_gate(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose code and unit stand more than once in their period; both rows are blocked."""
    rows = boq(spark, d).filter("code <> ''").select("rid", "direction", "period_no", "code", "unit")
    groups = rows.groupBy("direction", "period_no", "code", "unit").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(groups, ["direction", "period_no", "code", "unit"]).select("rid", "n")


def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: the best indel similarity among the shared words and the shared words with either rest."""

    def indel(x: str, y: str) -> float:
        if not x and not y:
            return 100.0
        row = [0] * (len(y) + 1)
        for ch in x:
            prev = 0
            for j, cy in enumerate(y, 1):
                prev, row[j] = row[j], prev + 1 if ch == cy else max(row[j], row[j - 1])
        return 200.0 * row[-1] / (len(x) + len(y))

    def one(x, y) -> float:
        if not isinstance(x, str) or not isinstance(y, str):
            return 0.0
        s, t = set(x.split()), set(y.split())
        both, sx, sy = " ".join(sorted(s & t)), " ".join(sorted(s - t)), " ".join(sorted(t - s))
        if both and (not sx or not sy):
            return 100.0
        ab, bb = f"{both} {sx}".strip(), f"{both} {sy}".strip()
        return max(indel(ab, bb), indel(both, ab) if both else 0.0, indel(both, bb) if both else 0.0)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct part names that share a word and score 85 or more: probable from 97, else suspected.

    Names are few and distinct; the join is by word, and each pair is scored once.
    """
    score = F.pandas_udf(token_set_ratio, "double")
    names = table(spark, d, "part").select("p_name").distinct()
    words = names.select("p_name", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    pairs = words.alias("a").join(words.alias("b"), F.col("a.w") == F.col("b.w")).filter("a.p_name < b.p_name").select(F.col("a.p_name").alias("name"), F.col("b.p_name").alias("other")).distinct()
    scored = pairs.withColumn("score", F.round(score("name", "other"), 2)).filter("score >= 85")
    return scored.withColumn("level", F.when(F.col("score") >= 97, "probable").otherwise("suspected"))


def fuzzy_groups(spark: SparkSession, d: str) -> DataFrame:
    """Uncoded names with what they are merged into (97 or more, greedily in name order) or suspected to be (85 or more)."""
    scored = cut_lineage(fuzzy_names(spark, d))
    merged = pairing.greedy_pairs(scored.filter("level = 'probable'").select("name", "other"), "name", "other")
    taken = merged.select(F.col("other").alias("name"), F.col("name").alias("into"), F.lit("probable").alias("level"))
    left = scored.join(merged.select("other"), "other", "left_anti").join(merged.select(F.col("other").alias("name")), "name", "left_anti")
    suspected = left.filter("level = 'suspected'").groupBy(F.col("other").alias("name")).agg(F.min_by(F.col("name"), F.struct(-F.col("score"), "name")).alias("into"))
    return taken.unionByName(suspected.withColumn("level", F.lit("suspected")))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The hundred groups most in need of review: by uncertainty, then known impact, then key (a top-k report)."""
    g = code_groups(spark, d)
    uncertainty = F.when(F.col("level") == "pending_data", 3).when(F.col("level") == "incomparable", 2).when(F.col("level") == "probable", 1).otherwise(0)
    return g.withColumn("uncertainty", uncertainty).orderBy(F.desc("uncertainty"), F.desc_nulls_last("n"), "direction", "code").limit(100).select("direction", "code", "uncertainty", "n")


def browse_page(spark: SparkSession, d: str) -> DataFrame:
    """One page of the items that lack an amount: ordered, offset, limited (a paging feature)."""
    rows = boq(spark, d).filter(F.col("amount").isNull() & F.col("name").contains("a"))
    return rows.orderBy(F.desc("unit_price"), "rid").offset(500).limit(500).select("rid", "code", "name", F.col("unit_price").cast("double").alias("unit_price"))


_NAME = "regexp_replace(lower(name), '[()\\[\\],.;:\\s_/\\-]', '', 'g')"
_LEVELS = f"""g AS (SELECT direction, code, count(*) AS n, count(DISTINCT name) AS names, count(DISTINCT CASE WHEN unit IN ('t', 'kg') THEN 't' ELSE unit END) AS units, count(DISTINCT feature) AS features FROM boq WHERE code <> '' GROUP BY ALL),
 l AS (SELECT *, CASE WHEN units > 1 OR features > 1 THEN 'incomparable' WHEN names > 1 THEN 'probable' ELSE 'confirmed' END AS level FROM g)"""
ORACLES = {
    "code_groups": boq_and(_LEVELS, "SELECT direction, code, n, names, units, features, level FROM l"),
    "name_code_components": boq_and(
        f"""e AS (SELECT DISTINCT 'c:' || code AS c, 'n:' || {_NAME} AS n FROM boq WHERE code <> ''), l AS (SELECT DISTINCT a.c AS x, b.c AS y FROM e a JOIN e b USING (n)),
        r AS (SELECT * FROM (WITH RECURSIVE w(root, x) AS (SELECT x, x FROM l UNION SELECT w.root, l.y FROM w JOIN l USING (x)) SELECT min(root) AS component, x FROM w GROUP BY x))""",
        "SELECT component, count(DISTINCT c) AS n_codes, count(DISTINCT n) AS n_names FROM r JOIN e ON e.c = r.x GROUP BY component",
    ),
    "uncoded_hosts": boq_and(
        f"h AS (SELECT direction, {_NAME} AS k, count(DISTINCT code) AS n, min(code) AS host FROM boq WHERE code <> '' GROUP BY 1, 2)",
        f"SELECT b.rid, CASE WHEN h.n = 1 THEN h.host END AS host, coalesce(h.n, 0) AS n_hosts FROM boq b LEFT JOIN h ON h.direction = b.direction AND h.k = {_NAME.replace('name', 'b.name')} WHERE b.code = ''",
    ),
    "duplicate_gate": over_boq("SELECT rid, n FROM (SELECT rid, count(*) OVER (PARTITION BY direction, period_no, code, unit) AS n FROM boq WHERE code <> '') WHERE n > 1"),
    "review_queue": boq_and(
        _LEVELS, "SELECT direction, code, CASE level WHEN 'incomparable' THEN 2 WHEN 'probable' THEN 1 ELSE 0 END AS uncertainty, n FROM l ORDER BY 3 DESC, n DESC NULLS LAST, direction, code LIMIT 100"
    ),
    "browse_page": over_boq("SELECT rid, code, name, CAST(unit_price AS DOUBLE) AS unit_price FROM boq WHERE amount IS NULL AND contains(name, 'a') ORDER BY unit_price DESC, rid LIMIT 500 OFFSET 500"),
}
QUERIES = {name: globals()[name] for name in ORACLES} | {"fuzzy_names": fuzzy_names, "fuzzy_groups": fuzzy_groups}
