"""Quantity ledger: quantities by item identity and scope, respecting how a source counts, and controls between sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantora.functions.numbers import PRODUCT, TOTAL
from quantora.operators.aggregate import several, unit_basis
from quantora.session import cut_lineage

# Statuses by severity, worst last.
SEVERITY = ("PASS", "PENDING", "INCOMPARABLE", "CONTROL_CONFLICT", "FAIL")


def identity(manual: Column | None = None) -> Column:
    """What an item is: a key given by hand, else name, feature and base unit where the unit is known, else its code, else its name."""
    key = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "(?U)\\s", "")
    base = unit_basis(F.col("unit"))["base"]
    given = F.nullif(F.trim(F.lit(None).cast("string") if manual is None else manual), F.lit(""))
    return F.when(given.isNotNull(), F.concat(F.lit("manual|"), given)).when((F.col("name") != "") & base.isNotNull(), F.concat_ws("|", F.lit("desc"), key("name"), key("feature"), base)).when(F.col("code") != "", F.concat(F.lit("code|"), F.col("code"))).otherwise(F.concat(F.lit("name|"), key("name")))


def scope_modes(items: DataFrame, scope: list[str]) -> DataFrame:
    """Scopes with their counting mode; a scope whose rows disagree is in conflict and has none."""
    g = items.groupBy(*scope).agg(several(F.col("mode")).alias("_several"), F.min("mode").alias("mode"), F.max("period_no").alias("_last"))
    return g.select(*scope, F.when(~F.col("_several"), F.col("mode")).alias("mode"), F.col("_several").alias("conflict"), "_last")


def rollup(items: DataFrame, scope: list[str]) -> DataFrame:
    """Quantity of each item and scope: incremental sources add up, cumulative ones count their last period only.

    Rows of scopes in conflict are left out; a missing quantity makes the sum missing.
    """
    modes = scope_modes(items, scope)
    basis = unit_basis(F.col("unit"))
    rows = items.drop("mode").join(modes, scope).filter(~F.col("conflict"))
    counted = rows.filter((F.col("mode") == "incremental") | (F.col("period_no") == F.col("_last")))
    std = counted.withColumn("item", identity()).withColumn("_q", (F.col("quantity") * basis["factor"]).cast(PRODUCT)).withColumn("_b", basis["base"])
    g = std.groupBy(*scope, "item").agg(F.count("*").alias("n_rows"), F.sum(F.col("_q").cast(TOTAL)).alias("_sum"), F.count_if(F.col("_q").isNull()).alias("_missing"), several(F.col("_b")).alias("_mixed"))
    status = F.when(F.col("_mixed"), "INCOMPARABLE").when(F.col("_missing") > 0, "PENDING").otherwise("PASS")
    return g.select(*scope, "item", "n_rows", F.when(status == "PASS", F.col("_sum")).alias("quantity"), status.alias("status"))


def control(ledger: DataFrame, upper: str, lower: str, side: str, scope: list[str]) -> DataFrame:
    """The lower side's quantity against the upper side's ceiling, per item: one verdict with its reason order.

    absent, stacked (several contributors), incomparable, missing, then FAIL where the
    lower side exceeds the ceiling, else PASS. The worst over the scopes is by severity.
    """
    one = lambda s, p: ledger.filter(F.col(side) == s).groupBy(*scope, "item").agg(
        F.count("*").alias(f"{p}_n"), F.max("quantity").alias(f"{p}_q"), F.bool_or(F.col("status") == "INCOMPARABLE").alias(f"{p}_x"), F.bool_or(F.col("quantity").isNull()).alias(f"{p}_m")
    )
    j = one(upper, "u").join(one(lower, "l"), [*scope, "item"], "full")
    verdict = (
        F.when(F.col("u_n").isNull(), "PENDING")
        .when(F.col("u_n") > 1, "CONTROL_CONFLICT")
        .when(F.col("u_x"), "INCOMPARABLE")
        .when(F.col("u_m"), "PENDING")
        .when(F.col("l_n").isNull(), "PASS")
        .when(F.col("l_x"), "INCOMPARABLE")
        .when(F.col("l_m"), "PENDING")
        .when(F.col("l_q") > F.col("u_q"), "FAIL")
        .otherwise("PASS")
    )
    return j.select(*scope, "item", F.col("u_q").alias("ceiling"), F.col("l_q").alias("used"), verdict.alias("verdict"))


def effective_contexts(contexts: DataFrame) -> DataFrame:
    """The confirmed contexts that no other confirmed one supersedes; ``contexts`` has id, status and supersedes_id."""
    confirmed = contexts.filter("status = 'confirmed'")
    replaced = confirmed.select(F.col("supersedes_id").alias("id")).filter("id is not null").distinct()
    return confirmed.join(replaced, "id", "left_anti")


def identity_conflicts(effective: DataFrame, keys: list[str]) -> DataFrame:
    """The effective contexts with ``conflict``: another effective context has the same business identity."""
    return effective.join(effective.groupBy(*keys).agg((F.count("*") > 1).alias("conflict")), keys)


def supersede_cycles(contexts: DataFrame) -> DataFrame:
    """id of the contexts that supersede themselves through others.

    Each round lets every context point as far as its pointer's pointer does, so paths
    double and chains end; what still points somewhere after as many doublings as the
    number of contexts has digits in binary is in a cycle or leads into one.
    """
    links = cut_lineage(contexts.filter("supersedes_id is not null").select("id", F.col("supersedes_id").alias("to")).dropDuplicates(["id"]))
    rounds = max(1, links.count().bit_length())
    jumps = links
    for _ in range(rounds):
        jumps = cut_lineage(jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("_next")), "to").select("id", F.col("_next").alias("to")))
    # What a long path ends in lies on the cycle; every member of a cycle is the end of such a path.
    return jumps.select(F.col("to").alias("id")).distinct()


def rollup_buildings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quantity of each item per building and over all of them (``building`` null), in one pass."""
    basis = unit_basis(F.col("unit"))
    std = rows.withColumn("_q", (F.col("quantity") * basis["factor"]).cast(PRODUCT))
    sets = [[*(F.col(k) for k in keys), F.col("building")], [F.col(k) for k in keys]]
    g = std.groupingSets(sets, *keys, "building").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("_q").cast(TOTAL)).alias("_sum"), F.count_if(F.col("_q").isNull()).alias("_missing"), F.grouping("building").cast("int").alias("over_all")
    )
    return g.select(*keys, "building", F.col("over_all") == 1, "n_rows", F.when(F.col("_missing") == 0, F.col("_sum")).alias("quantity"), "_missing").toDF(*keys, "building", "over_all", "n_rows", "quantity", "n_missing")


def two_ceilings(used: DataFrame, contract: DataFrame, settled: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    """Used quantities against the contract's and the settled ceiling: a verdict each, the worse of both, and its reason.

    ``used``, ``contract`` and ``settled`` have keys, quantity and ``n`` (contributors);
    ``pending`` has the keys whose open rows could change the conclusion.
    """
    named = lambda df, p: df.select(*keys, F.col("quantity").alias(f"{p}_quantity"), F.col("n").alias(f"{p}_n"))
    j = named(used, "used").join(named(contract, "contract"), keys, "full").join(named(settled, "settled"), keys, "full").join(pending.select(*keys).distinct().withColumn("_open", F.lit(True)), keys, "left")

    def verdict(p: str) -> Column:
        return (
            F.when(F.col(f"{p}_n").isNull(), "PENDING").when(F.col(f"{p}_n") > 1, "CONTROL_CONFLICT").when(F.col(f"{p}_quantity").isNull() | (F.col("used_n").isNotNull() & F.col("used_quantity").isNull()), "PENDING")
            .when(F.col("used_n").isNull(), "PASS").when(F.col("used_quantity") > F.col(f"{p}_quantity"), "FAIL").when(F.col("_open"), "PENDING").otherwise("PASS")
        )

    rank = lambda v: F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), v)
    out = j.withColumn("contract_verdict", verdict("contract")).withColumn("settled_verdict", verdict("settled"))
    worst = F.greatest(F.struct(rank(F.col("contract_verdict")).alias("r"), F.col("contract_verdict").alias("v")), F.struct(rank(F.col("settled_verdict")).alias("r"), F.col("settled_verdict").alias("v")))["v"]
    reason = (
        F.when(F.col("worst") == "PASS", "within both ceilings").when(F.col("worst") == "FAIL", "ceiling exceeded").when(F.col("worst") == "CONTROL_CONFLICT", "several ceilings")
        .when(F.col("contract_n").isNull() & F.col("settled_n").isNull(), "no ceiling").when(F.col("contract_n").isNull(), "no contract ceiling").when(F.col("settled_n").isNull(), "no settled ceiling")
        .when(F.col("used_n").isNotNull() & F.col("used_quantity").isNull(), "quantity missing").when(F.col("_open"), "open rows").otherwise("ceiling without quantity")
    )
    return out.withColumn("worst", worst).withColumn("reason", reason).select(*keys, "used_quantity", "contract_quantity", "settled_quantity", "contract_verdict", "settled_verdict", "worst", "reason")
