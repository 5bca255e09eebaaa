"""A mix of sources with target shares of all tokens, by entropy balancing.

Of all document rates that give each source its tokens and stay below its cap, the
one closest in entropy to "every document once" is an exponential tilt: rate =
min(cap, exp(lambda * tokens / scale)). The multipliers are the solution of a convex
dual, found by Newton steps, each one aggregate over the documents. Documents with
equal source and length have equal rates, so the aggregates run over that (lossless)
histogram. Rates are then rounded to copies systematically, so that each source
misses its tokens by about one document.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantora.session import cut_lineage

#: Folder and file of the public vocabulary that tokens are counted with.
TOKENIZER_FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
# The pattern that splits a text before byte pairs are merged.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Texts are encoded in pieces of about so many characters, cut only where no token can reach across:
# before white space, and where letters, digits and other signs meet (but for the apostrophe of 's, 't, ...).
PIECE = 20_000
_BORDER = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
#: Newton stops at this relative error of a source's tokens, or after so many steps.
TOLERANCE, STEPS = 1e-9, 60
#: Documents of one length that are ranked in one task.
RANKED = 4096


@lru_cache(4)
def encoding(folder: str, vocabulary: str):
    """The tokenizer of a rank file, once per Python worker."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The text in pieces whose tokens are those of the whole; a stretch without a border stays whole."""
    start = 0
    while len(text) - start > PIECE:
        border = _BORDER.search(text, start + PIECE)
        if border is None:
            break
        yield text[start : border.start()]
        start = border.start()
    yield text[start:]


def count_tokens(folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY):
    """A vectorised function of a text column: its number of tokens (0 for null)."""

    def count(texts: pd.Series) -> pd.Series:
        tokenizer = encoding(folder, vocabulary)

        def one(text) -> int:
            if not isinstance(text, str):
                return 0
            clean = text.encode("utf-8", "replace").decode("utf-8")
            return sum(len(tokenizer.encode_ordinary(piece)) for piece in pieces(clean))

        return texts.map(one).astype("int64")

    return F.pandas_udf(count, "bigint")


def source_name(c: Column) -> Column:
    """A source without outer white space and case."""
    return F.lower(F.trim(F.regexp_replace(c, "(?U)\\s+", " ")))


def _rate(tokens: Column, multiplier: Column, cap: Column, scale: Column) -> Column:
    """The tilted rate; a null multiplier stands for infinity: every document at its cap."""
    return F.when(multiplier.isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), F.exp(F.least(multiplier * tokens / scale, F.lit(700.0)))))


def balance(histogram: DataFrame, targets: list[dict]) -> list[dict]:
    """The multiplier of each target source, by safeguarded Newton steps on the dual.

    ``histogram``: source, n_tokens, n. ``targets``: source, cap, scale and tokens
    (wanted). Each step is one aggregate of all sources; Newton's step is taken where
    it stays in the bracket known to hold the solution, else the bracket is halved.
    """
    spark = histogram.sparkSession
    state = {t["source"]: dict(t, value=0.0, low=-math.inf, high=math.inf, done=t["tokens"] >= t["capacity"] * (1 - TOLERANCE) or t["capacity"] == 0) for t in targets}
    for s in state.values():
        if s["done"]:
            s["value"] = None
    for _ in range(STEPS):
        open_ = [s for s in state.values() if not s["done"]]
        if not open_:
            break
        params = F.broadcast(spark.createDataFrame([(s["source"], s["value"], float(s["cap"]), s["scale"]) for s in open_], "source string, value double, cap double, scale double"))
        x = F.col("value") * F.col("n_tokens") / F.col("scale")
        rate = F.exp(F.least(x, F.lit(700.0)))
        free = rate < F.col("cap")
        weight = F.col("n") * F.col("n_tokens")
        sums = (
            histogram.join(params, "source")
            .groupBy("source")
            .agg(
                F.sum(weight * F.least(rate, F.col("cap"))).alias("tokens"),
                F.sum(F.when(free, weight * rate * F.col("n_tokens") / F.col("scale")).otherwise(0.0)).alias("slope"),
            )
            .collect()
        )  # one row per target source
        for row in sums:
            s = state[row["source"]]
            error = row["tokens"] - s["tokens"]
            if abs(error) <= TOLERANCE * max(1.0, s["tokens"]):
                s["done"] = True
                continue
            s["low"], s["high"] = (s["value"], s["high"]) if error < 0 else (s["low"], s["value"])
            newton = s["value"] - error / row["slope"] if row["slope"] > 0 else math.nan
            if not s["low"] < newton < s["high"]:
                if math.isinf(s["high"]):
                    newton = max(1.0, s["low"] * 2)
                elif math.isinf(s["low"]):
                    newton = min(-1.0, s["high"] * 2)
                else:
                    newton = (s["low"] + s["high"]) / 2
            if newton == s["value"]:
                s["done"] = True
            s["value"] = newton
    return list(state.values())


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(the mix, the shares reached).

    The mix has one row per used document: doc_id, source, n_tokens, rate, copies.
    The report has one row per target source: source, target_share, share, target_tokens,
    n_tokens, n_documents, n_used, n_copies, most_copies, at_cap. ``total_tokens`` is
    the size of the mix; left out, it is the largest that all shares allow.

    Defined cases: sources are compared without case and outer white space; documents
    without id or of a source that is no target are left out; a doc_id delivered in
    several rows counts once (the smallest source and size); empty texts have no
    tokens and are never used; targets without a positive share or cap are left out,
    and the other shares are scaled to sum to 1; a target source without tokens gets
    none and is reported with share 0, the others keep their relative shares; empty
    tables give no rows; other columns are not read.
    """
    spark = documents.sparkSession
    wanted = {}
    rows = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeat").cast("int").alias("cap"))
    rows = rows.filter((F.col("share") > 0) & (F.col("cap") > 0) & F.col("source").isNotNull()).groupBy("source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap"))
    if (n := rows.count()) > 100_000:
        raise ValueError(f"{n} target sources")
    for r in rows.collect():
        wanted[r["source"]] = {"source": r["source"], "share": r["share"], "cap": r["cap"]}
    listed = F.broadcast(spark.createDataFrame([(k,) for k in wanted], "source string"))
    sized = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").alias("_text")).filter(F.col("doc_id").isNotNull())
    counted = sized.join(listed, "source").select("doc_id", "source", count_tokens(folder, vocabulary)(F.col("_text")).alias("n_tokens"))
    single = cut_lineage(counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.*").filter(F.col("n_tokens") > 0))
    histogram = cut_lineage(single.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))

    have = {r["source"]: r for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("n")).collect()}
    total_share = sum(t["share"] for s, t in wanted.items() if s in have) or 1.0
    plan = []
    for s, t in wanted.items():
        known = have.get(s)
        tokens = int(known["tokens"]) if known else 0
        plan.append(t | {"share": t["share"] / total_share if known else 0.0, "capacity": float(tokens * t["cap"]), "scale": tokens / known["n"] if known else 1.0, "n": int(known["n"]) if known else 0})
    feasible = min((p["capacity"] / p["share"] for p in plan if p["share"] > 0), default=0.0)
    total = feasible if total_tokens is None else min(float(total_tokens), feasible)
    solved = balance(histogram, [p | {"tokens": total * p["share"]} for p in plan])
    params = F.broadcast(
        spark.createDataFrame(
            [(p["source"], p["value"], p["cap"], p["scale"], p["share"], p["tokens"]) for p in solved],
            "source string, value double, cap int, scale double, target_share double, target_tokens double",
        )
    )
    rated = histogram.join(params, "source").withColumn("rate", _rate(F.col("n_tokens"), F.col("value"), F.col("cap"), F.col("scale")))
    rated = rated.withColumn("base", F.floor(F.col("rate") + F.lit(1e-12)).cast("int"))
    # Systematic rounding along the lengths: the running sum of fractions, rounded, gives each length its extra copies.
    along = Window.partitionBy("source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.col("n") * F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))).over(along)
    before = running - F.col("n") * F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))
    cells = rated.withColumn("extra", (F.round(running) - F.round(before)).cast("bigint")).withColumn("extra", F.least(F.greatest(F.col("extra"), F.lit(0)), F.col("n")))
    cells = cut_lineage(cells.select("source", "n_tokens", "n", "rate", "base", "extra", "cap", F.ceil(F.col("n") / F.lit(RANKED)).alias("parts")))

    # Which documents of a length get the extra copy: the first by hash, ranked in parts of bounded size.
    hashed = single.join(cells, ["source", "n_tokens"]).withColumn("_h", F.xxhash64("doc_id")).withColumn("part", F.pmod(F.shiftrightunsigned("_h", 32), F.col("parts")))
    sizes = hashed.groupBy("source", "n_tokens", "part", "n", "extra").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    quota = sizes.select("source", "n_tokens", "part", (F.floor(F.col("extra") * upto / F.col("n")) - F.floor(F.col("extra") * (upto - F.col("m")) / F.col("n"))).alias("quota"))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "part").orderBy("_h", "doc_id"))
    drawn = (
        hashed.withColumn("_rank", rank)
        .join(quota, ["source", "n_tokens", "part"])
        .select("doc_id", "source", "n_tokens", "rate", F.least(F.col("cap"), F.col("base") + F.when(F.col("_rank") <= F.col("quota"), 1).otherwise(0)).cast("int").alias("copies"))
        .filter(F.col("copies") > 0)
    )
    used = drawn.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.count("*").alias("n_used"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies")
    )
    known = F.broadcast(spark.createDataFrame([(p["source"], p["n"]) for p in solved], "source string, n_documents bigint"))
    report = params.join(known, "source").join(used, "source", "left")
    everything = F.sum(F.coalesce("n_tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # one row per target source
    report = report.select(
        "source",
        "target_share",
        F.coalesce(F.try_divide(F.coalesce("n_tokens", F.lit(0)), everything), F.lit(0.0)).alias("share"),
        F.round("target_tokens").cast("bigint").alias("target_tokens"),
        F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
        "n_documents",
        F.coalesce("n_used", F.lit(0)).alias("n_used"),
        F.coalesce("n_copies", F.lit(0)).cast("bigint").alias("n_copies"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.col("value").isNull().alias("at_cap"),
    )
    return drawn, report
