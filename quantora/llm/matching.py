"""Entities matched across sources without a common key.

The items of the catalogue (one code and description each) are what records of both
sources may mean. Lines of one source and rows of the other are each compared with
items, each comparison a vector of similarities, and for each source a regularised
Gaussian mixture separates matched from unmatched vectors without labels. Two items
are different things, so a record can mean one of them at most, and every E-step gives
posteriors under that constraint, over all items whether the project has them or not.
Line, row and item thus fall into one class or none: matches are transitive, and the
confidence that a line and a row mean the same is the product of their posteriors.

The words of two sources differ, so similarities of texts use associations of tokens
that are learned from the rows whose (noisy) code leads to a group of items. Texts
are compared once per distinct description, within the sections that its words and
code point to; rows meet items of their own project by an equi-join.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantora.functions.lookalikes import skeleton
from quantora.functions.numbers import to_decimal
from quantora.functions.units import read_unit
from quantora.session import cut_lineage, default_parallelism, shuffle_partitions

#: Digits of a code that name a section, and a group of items within it; shorter codes are none.
SECTION, GROUP = 4, 9
#: A token's association counts from so many descriptions and this strength on.
LEAST_SEEN, LEAST_LINK = 3, 0.25
#: Tokens in nearly all items of a section say nothing.
COMMON = 0.95
#: A row is compared in the sections that get this share of the best section's evidence.
SECTION_SHARE = 0.5
#: Comparisons kept: not further than this below the row's best one.
WINDOW = 0.8
#: Descriptions scored in one group of a section.
GROUP_ROWS = 1000
#: Least standard deviation of a feature, EM steps, change of the log likelihood that ends them, and the posterior of a match.
FLOOR, STEPS, SETTLED, MATCHED = 0.05, 25, 1e-5, 0.5
#: Log price ratios beyond this come from a misread unit and have no say.
PRICE_WINDOW = 1.0
FEATURES = ("recall", "precision", "numbers", "code", "margin", "price")
#: Of lines: equal code, description and name, and how much nearer the item's price in the project is than that of
#: items which are equal so far (prices are near by e-fold steps of PRICE_STEP).
LINE_FEATURES, PRICE_STEP = ("code", "feature", "name", "price"), 0.02

# Statements of the unit within a description, item numbers before a text, remarks behind a name.
_UNIT_STATEMENT = re.compile(r"[,;]?(?:按[^,;()按]{1,12}?计量|以[^,;()以]{1,12}?计|【[^】]{1,12}】计|\(?(?:计量单位|单位|unit):[^,;()]+\)?)$")
_ENUMERATION = re.compile(r"^\d{1,3}[、.)](?!\d)")
_REMARK = re.compile(r"(?<=.{3})(?:\([^()]{1,8}\)|,[^,()]{1,4})$")
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[a-zß-öø-ɏḀ-ỿ]+|[㐀-鿿]+")


def flat(text) -> str:
    """A text in its one form, without white space."""
    return re.sub(r"\s", "", skeleton(text)) if isinstance(text, str) else ""


def code_digits(text) -> str:
    """The digits of a code, or nothing if they are fewer than a group's."""
    digits = re.sub(r"\D", "", flat(text))
    return digits if len(digits) >= GROUP else ""


def tokens(name: str, feature: str) -> list[str]:
    """Numbers, words of Latin letters and pairs of ideograms of both texts, each once."""
    out = set()
    for text in (name, feature):
        for t in _TOKEN.findall(_ENUMERATION.sub("", text)):
            if t[0].isdigit():
                out.add("n:" + (t.rstrip("0").rstrip(".") if "." in t else t.lstrip("0") or "0"))
            elif "㐀" <= t[0] <= "鿿":
                out.update(t[i : i + 2] for i in range(max(1, len(t) - 1)))
            else:
                out.add("w:" + t)
    return sorted(out)


def _each(values: pd.Series, f) -> list:
    """f of every value, computed once per distinct value."""
    which, distinct = pd.factorize(values)
    done = [f(v) for v in distinct]
    empty = f(None)
    return [done[i] if i >= 0 else empty for i in which]


def _unit_factor(unit) -> float:
    return float(read_unit(unit)[1] or 1.0) if isinstance(unit, str) and unit.strip() else 1.0


def _normalise(remarks: bool):
    def run(code: pd.Series, name: pd.Series, feature: pd.Series, unit: pd.Series) -> pd.DataFrame:
        bare = (lambda x: _ENUMERATION.sub("", flat(x))) if remarks else (lambda x: _REMARK.sub("", _ENUMERATION.sub("", flat(x))))
        return pd.DataFrame(
            {
                "code": _each(code, code_digits),
                "name": _each(name, bare),
                "feature": _each(feature, lambda x: _UNIT_STATEMENT.sub("", flat(x))),
                "factor": _each(unit, _unit_factor),
            }
        )

    return run


def _normalised(rows: DataFrame, row_id: str, remarks: bool) -> DataFrame:
    """row_id, project, and the normalised code, name, feature and price per base unit (log) of each row.

    Without ``remarks`` a bracketed or trailing remark behind a name is dropped, so that lines of one item agree.
    """
    udf = F.pandas_udf(_normalise(remarks), "code string, name string, feature string, factor double")
    price = to_decimal(F.col("unit_price").cast("string"), "decimal(24,8)").cast("double")
    each = rows.select(
        F.col(row_id).alias("row_id"),
        F.col("_project").alias("project"),
        udf(*[F.col(c).cast("string") for c in ("code", "name", "feature", "unit")]).alias("t"),
        price.alias("_price"),
    )
    per_unit = F.when((F.col("_price") > 0) & (F.col("t.factor") > 0), F.log(F.col("_price") / F.col("t.factor")))
    return each.select("row_id", "project", "t.code", "t.name", "t.feature", per_unit.alias("price"))


def _tokenised(rows: DataFrame) -> DataFrame:
    split = F.pandas_udf(lambda n, f: pd.Series([tokens(a, b) for a, b in zip(n, f, strict=True)]), "array<string>")
    return rows.withColumn("tokens", split("name", "feature"))


def catalogue(lines: DataFrame) -> DataFrame:
    """The items: item (id), code, feature, section, group, tokens. Lines with code and description define them."""
    coded = lines.filter((F.col("code") != "") & (F.col("feature") != ""))
    named = coded.groupBy("code", "feature", "name").agg(F.count("*").alias("n"))
    best = named.groupBy("code", "feature").agg(F.max(F.struct("n", "name")).alias("b")).select("code", "feature", "b.name")
    return _tokenised(best).select(
        F.xxhash64("code", "feature").alias("item"), "code", "name", "feature", F.substring("code", 1, SECTION).alias("section"), F.substring("code", 1, GROUP).alias("group"), "tokens"
    )


def compare_lines(lines: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kinds, comparisons): the distinct lines of each project, and the items that each may bill.

    A line with code and description is compared with that item, and as one without
    description with the items of its code in its project, and with the only item of
    the code; one without code with the items of its name and description, and with
    those of its name in its project. Comparisons have the LINE_FEATURES, ``here``
    (complete lines of the project bill the item) and ``n`` (the lines of the kind).
    """
    keyed = _kind_keys(lines)
    texts = [F.first(c).alias(c) for c in ("project", "code", "name", "feature", "price")]
    kinds = cut_lineage(keyed.groupBy("_h", "_g").agg(*texts, F.count("*").alias("n")).withColumn("row_id", F.monotonically_increasing_id()))
    full = kinds.filter("code <> '' and feature <> ''").join(items.select("code", "feature", "item"), ["code", "feature"])
    local = full.groupBy("project", "item", "code", "feature").agg(F.percentile_approx("price", 0.5).alias("_of"), F.max("name").alias("_name"))
    local = cut_lineage(local)
    names = full.groupBy("project", "name", "item").agg(F.first("feature").alias("_feature"))
    told = full.select("name", "feature", "item").distinct()
    single = items.groupBy("code").agg(F.count("*").alias("_n"), F.min("item").alias("item"), F.min("name").alias("_name")).filter("_n = 1")
    coded, uncoded = kinds.filter("code <> ''"), kinds.filter("code = '' and name <> ''")
    yes, no = F.lit(1.0), F.lit(None).cast("double")
    same = lambda c: F.when(F.col(c) != "", (F.col(c) == F.col(f"_{c}")).cast("double"))
    told_by = lambda rows, code, feature, name: rows.select("row_id", "item", code.alias("code"), feature.alias("feature"), name.alias("name"))
    # What is equal is known where a candidate is found, so no text is looked up again.
    candidates = (
        told_by(full, yes, yes, yes)
        .unionByName(told_by(coded.join(local.withColumnRenamed("feature", "_feature"), ["project", "code"]), yes, same("feature"), same("name")))
        .unionByName(told_by(coded.filter("feature = ''").join(single, "code"), yes, no, same("name")))
        .unionByName(told_by(uncoded.filter("feature <> ''").join(told, ["name", "feature"]), no, yes, yes))
        .unionByName(told_by(uncoded.join(names, ["project", "name"]), no, same("feature"), yes))
        .groupBy("row_id", "item")
        .agg(*[F.max(c).alias(c) for c in ("code", "feature", "name")])
    )
    near = F.exp(-F.abs(F.col("price") - F.col("_of")) / F.lit(PRICE_STEP))
    compared = (
        candidates.join(kinds.select("row_id", "project", "price", "n"), "row_id")
        .join(local.select("project", "item", "_of", F.lit(True).alias("here")), ["project", "item"], "left")
        .select("row_id", "project", "item", "n", "code", "feature", "name", near.alias("_near"), F.coalesce("here", F.lit(False)).alias("here"))
    )
    rivals = Window.partitionBy("row_id", "code", "feature", "name", "here").orderBy(F.desc_nulls_last("_near"), "item")
    best_other = F.when(F.row_number().over(rivals) == 1, F.lead("_near").over(rivals)).otherwise(F.first("_near").over(rivals))
    margin = compared.repartition("row_id").withColumn("price", F.col("_near") - best_other).drop("_near")
    return kinds.select("_h", "_g", "row_id"), cut_lineage(margin.sortWithinPartitions("row_id", "item"))


def _kind_keys(lines: DataFrame) -> DataFrame:
    """The lines with 128 bits of hash of what makes them one kind."""
    by = ("project", "code", "name", "feature", "price")
    return lines.withColumn("_h", F.xxhash64(*by)).withColumn("_g", F.xxhash64(F.lit(1), *by))


def lines_to_items(lines: DataFrame, items: DataFrame) -> DataFrame:
    """row_id, project, item, price, confidence: the item that each line bills, by the posteriors of the lines' mixture."""
    kinds, compared = compare_lines(lines, items)
    if compared.isEmpty():
        return lines.limit(0).select("row_id", "project", F.lit(0).cast("bigint").alias("item"), "price", F.lit(0.0).alias("confidence"))
    mixture = fit_mixture(compared, LINE_FEATURES)
    judged = compared.mapInPandas(_posteriors(mixture, local=False), _JUDGED).filter(F.col("confidence") > MATCHED)
    billed = kinds.join(judged.select("row_id", "item", "confidence"), "row_id").drop("row_id")
    return _kind_keys(lines).select("row_id", "project", "price", "_h", "_g").join(billed, ["_h", "_g"]).drop("_h", "_g").select("row_id", "project", "item", "price", "confidence")


def associations(items: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, sections): what a token of the other source says about tokens of the items, and about sections.

    links: token, item_token, link — how much likelier the item token is with the token
    than in the section at large, over the texts whose code leads to a group of items.
    sections: token, section, share.
    """
    of_items = cut_lineage(items.select("item", "section", "group", F.explode("tokens").alias("u")))
    per_section = items.groupBy("section").agg(F.count("*").alias("_items"))
    base = of_items.groupBy("section", "u").agg(F.count("*").alias("_n")).join(per_section, "section").select("section", "u", (F.col("_n") / F.col("_items")).alias("_base"))
    per_group = items.groupBy("group").agg(F.count("*").alias("_items"))
    inside = of_items.groupBy("group", "u").agg(F.count("*").alias("_n")).join(per_group, "group").select("group", "u", (F.col("_n") / F.col("_items")).alias("_in"))
    coded = texts.filter(F.col("code") != "").select(F.substring("code", 1, GROUP).alias("group"), F.explode("tokens").alias("t")).filter(~F.col("t").startswith("n:"))
    led = cut_lineage(coded.join(per_group.select("group"), "group").groupBy("t", "group").agg(F.count("*").alias("_seen")))
    seen = led.groupBy("t").agg(F.sum("_seen").alias("_all")).filter(F.col("_all") >= LEAST_SEEN)
    by_section = led.groupBy("t", F.substring("group", 1, SECTION).alias("section")).agg(F.sum("_seen").alias("_seen"))
    with_t = led.join(inside, "group").groupBy("t", "u").agg(F.sum(F.col("_seen") * F.col("_in")).alias("_with"))
    at_large = by_section.join(base, "section").groupBy("t", "u").agg(F.sum(F.col("_seen") * F.col("_base")).alias("_large"))
    p, b = F.col("_with") / F.col("_all"), F.col("_large") / F.col("_all")
    links = (
        with_t.join(at_large, ["t", "u"])
        .join(seen, "t")
        .select("t", "u", F.when(b < COMMON, (p - b) / (1 - b)).otherwise(0.0).alias("link"))
        .filter(F.col("link") >= LEAST_LINK)
    )
    own = of_items.filter(~F.col("u").startswith("n:")).select(F.col("u").alias("t"), "section").distinct()
    own = own.join(own.groupBy("t").agg((1.0 / F.count("*")).alias("share")), "t")
    learned = by_section.join(seen, "t").select("t", "section", (F.col("_seen") / F.col("_all")).alias("share"))
    sections = own.unionByName(learned.select("t", "section", "share")).groupBy("t", "section").agg(F.max("share").alias("share"))
    return links, sections


def _score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The similarities of a group of descriptions with the items of one section."""
    columns = ["text", "item", "recall", "precision", "numbers", "code", "total"]
    own = right[right["kind"] == "item"]
    if left.empty or own.empty:
        return pd.DataFrame({c: pd.Series(dtype="int64" if c in ("text", "item") else "float64") for c in columns})
    item_tokens = [list(t) for t in own["tokens"]]
    vocabulary = sorted(set().union(*map(set, item_tokens)))
    u_at = {u: i for i, u in enumerate(vocabulary)}
    member = np.zeros((len(own), len(vocabulary)), np.float32)
    for i, t in enumerate(item_tokens):
        member[i, [u_at[u] for u in t]] = 1
    weight = -np.log(np.clip(member.mean(0), 1e-4, 1.0))
    weight[weight < 0.05] = 0
    weighted = member * weight
    weighted /= np.maximum(weighted.sum(1, keepdims=True), 1e-9)

    row_tokens = [list(t) for t in left["tokens"]]
    names = sorted(set().union(*map(set, row_tokens)))
    t_at = {t: i for i, t in enumerate(names)}
    link = np.zeros((len(names), len(vocabulary)), np.float32)
    links = right[right["kind"] == "link"]
    for t, u, a in zip(links["t"], links["u"], links["link"], strict=True):
        if t in t_at and u in u_at:
            link[t_at[t], u_at[u]] = a
    for t, i in t_at.items():
        if t in u_at:
            link[i, u_at[t]] = 1
    # The best link of each token into each item, by items, so that memory stays small.
    into = np.stack([link[:, m > 0].max(1) for m in member], axis=1)
    is_number = np.array([t.startswith("n:") for t in names])
    says = np.where(is_number, 1.0, link.max(1))
    codes = [str(c) for c in own["code"]]
    item_ids = own["item"].to_numpy(np.int64)
    prefixes = np.array([[ord(ch) for ch in c[:GROUP].ljust(GROUP)] for c in codes])
    out = []
    for text, code, own_tokens in zip(left["text"].tolist(), left["code"].tolist(), row_tokens, strict=True):
        at = [t_at[t] for t in own_tokens]
        if not at:
            continue
        recall = weighted @ link[at].max(0)
        precision = (says[at] @ into[at]) / max(says[at].sum(), 1e-9)
        figures = [i for i in at if is_number[i]]
        numbers = into[figures].mean(0) if figures else np.ones(len(own))
        same = (prefixes == np.array([ord(ch) for ch in code[:GROUP]])).mean(1) if code else np.full(len(own), np.nan)
        total = recall + precision + 0.5 * numbers + 0.5 * np.nan_to_num(same)
        keep = np.flatnonzero(total >= total.max() - WINDOW)
        out.append(pd.DataFrame({"text": text, "item": item_ids[keep], "recall": recall[keep], "precision": precision[keep], "numbers": numbers[keep], "code": same[keep], "total": total[keep]}))
    return pd.concat(out)[columns] if out else pd.DataFrame({c: pd.Series(dtype="int64" if c in ("text", "item") else "float64") for c in columns})


_SCORED = "text bigint, item bigint, recall double, precision double, numbers double, code double, total double"


def compare_texts(items: DataFrame, texts: DataFrame) -> DataFrame:
    """The similarities of each description with the items it may mean, and the margin to its best other item."""
    links, sections = associations(items, texts)
    words = texts.select("text", F.explode("tokens").alias("t"))
    pointed = words.join(sections, "t").select("text", "section", "share")
    by_code = texts.filter(F.col("code") != "").select("text", F.substring("code", 1, SECTION).alias("section"), F.lit(1.0).alias("share"))
    evidence = pointed.unionByName(by_code).groupBy("text", "section").agg(F.sum("share").alias("share"))
    best = F.max("share").over(Window.partitionBy("text"))
    chosen = evidence.withColumn("_best", best).filter(F.col("share") >= SECTION_SHARE * F.col("_best")).select("text", "section")
    placed = cut_lineage(chosen.join(items.select("section").distinct(), "section").join(texts.select("text", "code", "tokens"), "text"))
    parts = placed.groupBy("section").agg(F.ceil(F.count("*") / F.lit(GROUP_ROWS)).cast("int").alias("_parts"))
    left = placed.join(parts, "section").select(F.concat("section").alias("section"), F.pmod(F.xxhash64("text", F.lit(7)), F.col("_parts")).cast("int").alias("part"), "text", "code", "tokens")
    vocabulary = items.select("section", F.explode("tokens").alias("u")).distinct()
    spread = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part")
    none = lambda kind: F.lit(None).cast(kind)
    model = items.select("section", F.lit("item").alias("kind"), "item", "code", "tokens", none("string").alias("t"), none("string").alias("u"), none("double").alias("link")).unionByName(
        links.join(vocabulary, "u").select("section", F.lit("link").alias("kind"), F.lit(0).cast("bigint").alias("item"), none("string").alias("code"), none("array<string>").alias("tokens"), "t", "u", "link")
    )
    right = model.join(parts, "section").select(F.concat("section").alias("section"), spread, "kind", "item", "code", "tokens", "t", "u", "link")
    # A fixed number of partitions: the groups are small in bytes but not in work, so AQE must not merge them.
    n = max(shuffle_partitions(items.sparkSession), default_parallelism(items.sparkSession))
    left, right = left.repartition(n, "section", "part"), right.repartition(n, "section", "part")
    scored = left.groupBy("section", "part").cogroup(right.groupBy("section", "part")).applyInPandas(_score, _SCORED)
    of_text = Window.partitionBy("text").orderBy(F.desc("total"), "item")
    ranked = scored.withColumn("_rank", F.row_number().over(of_text)).withColumn("_next", F.lead("total").over(of_text)).withColumn("_top", F.first("total").over(of_text))
    margin = F.when(F.col("_rank") == 1, F.col("total") - F.coalesce("_next", F.lit(0.0))).otherwise(F.col("total") - F.col("_top"))
    return ranked.filter(F.col("total") >= F.col("_top") - WINDOW).withColumn("margin", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), margin)))


class Mixture:
    """Two diagonal Gaussians over vectors with gaps, the share of each that is in the project, and the matched weight."""

    def __init__(self, features: tuple[str, ...], weight: float, mean: np.ndarray, sd: np.ndarray, present: np.ndarray):
        self.features, self.weight, self.mean, self.sd, self.present = features, weight, mean, sd, present

    def log_odds(self, x: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of being matched and the log likelihood, comparison by comparison; a missing feature has no say."""
        there = ~np.isnan(x)
        filled = np.where(there, x, 0.0)
        logs = []
        for k, w in ((0, 1 - self.weight), (1, self.weight)):
            z = (filled - self.mean[k]) / self.sd[k]
            density = np.where(there, -0.5 * z * z - np.log(self.sd[k]) - 0.9189385, 0.0).sum(1)
            logs.append(math.log(w) + density + np.where(here, math.log(self.present[k]), math.log(1 - self.present[k])))
        return logs[1] - logs[0], np.logaddexp(*logs)


def one_item_each(log_odds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Posteriors under the constraint that a row (equal neighbours in ``rows``) means one item at most.

    Items are different things, so a row that matches one matches no other: the
    outcomes of a row are "none" and each of its items, weighted by their odds.
    """
    if not len(rows):
        return np.zeros(0)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    lengths = np.diff(np.r_[starts, len(rows)])
    top = np.maximum(np.maximum.reduceat(log_odds, starts), 0.0)
    high = np.exp(log_odds - np.repeat(top, lengths))
    return high / np.repeat(np.exp(-top) + np.add.reduceat(high, starts), lengths)


def _whole_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches, cut so that no row's comparisons are split; rows come sorted."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        last = pdf["row_id"].iloc[-1] if len(pdf) else None
        head = pdf[pdf["row_id"] != last]
        rest = pdf[pdf["row_id"] == last]
        if len(head):
            yield head
    if rest is not None and len(rest):
        yield rest


def _first_odds(x: np.ndarray, features: tuple[str, ...]) -> np.ndarray:
    """Odds to begin with: what the similarities say at face value."""
    if features == FEATURES:
        sure = ((x[:, 0] + x[:, 1] + x[:, 2]) / 3 >= 0.9) & (x[:, 4] > 0)
    else:
        sure = (np.nan_to_num(x[:, :3], nan=1.0).min(1) >= 1) & (np.nan_to_num(x[:, 3]) >= 0)
    return np.where(sure, 3.0, -3.0)


def _statistics(mixture: Mixture | None, features: tuple[str, ...]):
    """Sums for one M-step over a partition: per component the weight, those in the project, and by feature n, x, x squared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, weights, likelihood = np.zeros((2, 3, len(features))), np.zeros((2, 2)), 0.0
        for pdf in _whole_rows(batches):
            x, here, n = pdf[list(features)].to_numpy(np.float64), pdf["here"].to_numpy(bool), pdf["n"].to_numpy(np.float64)
            if mixture is None:
                odds = _first_odds(x, features)
            else:
                odds, part = mixture.log_odds(x, here)
                likelihood += float((part * n).sum())
            g = one_item_each(odds, pdf["row_id"].to_numpy())
            there, filled = ~np.isnan(x), np.nan_to_num(x)
            for k, w in ((0, (1 - g) * n), (1, g * n)):
                weights[k] += w.sum(), w[here].sum()
                sums[k] += np.stack([(w[:, None] * there).sum(0), (w[:, None] * filled).sum(0), (w[:, None] * filled * filled).sum(0)])
        yield pd.DataFrame({"s": [np.r_[weights.ravel(), sums.ravel(), likelihood].tolist()]})

    return run


def fit_mixture(pairs: DataFrame, features: tuple[str, ...] = FEATURES) -> Mixture:
    """EM over all comparisons; each step is one pass that returns a few sums per partition.

    Each variance is drawn towards the squared distance of the two means (a share of
    it is added) and never falls below FLOOR squared, so that features which are
    constant within a component cannot take over.
    """
    mixture, before = None, -math.inf
    for _ in range(STEPS):
        parts = pairs.mapInPandas(_statistics(mixture, features), "s array<double>").collect()  # one row per partition
        total = np.sum([p["s"] for p in parts], axis=0)
        weights, sums, likelihood = total[:4].reshape(2, 2), total[4:-1].reshape(2, 3, len(features)), total[-1]
        n, x, xx = np.maximum(sums[:, 0], 1e-9), sums[:, 1], sums[:, 2]
        mean = x / n
        apart = (mean[1] - mean[0]) ** 2
        variance = np.maximum(xx / n - mean**2, 0) + 0.02 * apart + FLOOR**2
        share = np.clip(weights[1, 0] / max(weights[:, 0].sum(), 1e-9), 1e-6, 1 - 1e-6)
        present = np.clip((weights[:, 1] + 1) / (weights[:, 0] + 2), 1e-4, 1 - 1e-4)
        mixture = Mixture(features, float(share), mean, np.sqrt(variance), present)
        if abs(likelihood - before) <= SETTLED * abs(before):
            break
        before = likelihood if likelihood else -math.inf
    return mixture


_JUDGED = "row_id bigint, project bigint, item bigint, confidence double"


def _posteriors(mixture: Mixture, local: bool = True):
    """Posteriors of all comparisons, or of those ``local`` to the project."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_rows(batches):
            odds, _ = mixture.log_odds(pdf[list(mixture.features)].to_numpy(np.float64), pdf["here"].to_numpy(bool))
            pdf = pdf.assign(confidence=one_item_each(odds, pdf["row_id"].to_numpy()))
            yield pdf.loc[pdf["here"] | (not local), ["row_id", "project", "item", "confidence"]]

    return run


def match_items(lines: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, line items of each item): which item of its project each row means.

    ``lines`` and ``rows`` have id, _project, code, name, feature, unit, unit_price.
    matches: row_id, project, item, confidence — comparisons whose posterior exceeds
    MATCHED; a row that two items explain equally well has none. The second table has
    row_id (of the line), project, item, price and confidence.

    Defined cases: rows and lines without project, name or id match nothing; missing
    codes, descriptions, units and prices have no say; repeated rows are matched each;
    without any line that has a code and a description nothing can match; empty tables
    give no rows; other columns are not read.
    """
    own = cut_lineage(_normalised(lines.filter(F.col("id").isNotNull() & F.col("_project").isNotNull()), "id", False))
    theirs = cut_lineage(_normalised(rows.filter(F.col("id").isNotNull() & F.col("_project").isNotNull()), "id", True).withColumn("text", F.xxhash64("code", "name", "feature")))
    items = cut_lineage(catalogue(own))
    billed = cut_lineage(lines_to_items(own, items))
    texts = cut_lineage(_tokenised(theirs.filter(F.col("name") != "").select("text", "code", "name", "feature").distinct()).select("text", "code", "tokens"))
    scored = compare_texts(items, texts)
    in_project = billed.groupBy("project", "item").agg(F.percentile_approx("price", 0.5).alias("_of"))
    pairs = (
        theirs.select("row_id", "project", "text", "price")
        .join(scored, "text")
        .join(in_project.withColumn("here", F.lit(True)), ["project", "item"], "left")
        .select(
            "row_id", "project", "item", F.lit(1).alias("n"), "recall", "precision", "numbers", "code", "margin",
            F.when(F.abs(F.col("price") - F.col("_of")) <= PRICE_WINDOW, F.col("price") - F.col("_of")).alias("price"),
            F.coalesce("here", F.lit(False)).alias("here"),
        )
    )
    pairs = cut_lineage(pairs.repartition("row_id").sortWithinPartitions("row_id", "item"))
    if pairs.isEmpty():
        return pairs.select("row_id", "project", "item", F.lit(0.0).alias("confidence")), billed
    mixture = fit_mixture(pairs)
    judged = pairs.mapInPandas(_posteriors(mixture), _JUDGED)
    return judged.filter(F.col("confidence") > MATCHED), billed


def match_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """line_item_id, row_id and confidence of every pair of a line and a row that mean the same item of a project.

    Both must mean the item, so the confidence is the product of the two posteriors;
    pairs whose product exceeds MATCHED are matches.
    """
    matches, billed = match_items(lines, rows)
    line = billed.select(F.col("row_id").alias("line_item_id"), "project", "item", F.col("confidence").alias("_billed"))
    pairs = matches.join(line, ["project", "item"]).select("line_item_id", "row_id", (F.col("confidence") * F.col("_billed")).alias("confidence"))
    return pairs.filter(F.col("confidence") > MATCHED)
