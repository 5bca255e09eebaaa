"""Run signatures, drift between runs, and canonical digests of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_digest(df: DataFrame, name: str) -> DataFrame:
    """component, n_rows and a digest that depends on the rows but not on their order or partitioning.

    Row hashes are added up as exact decimals and as XOR, so the aggregate needs no sort
    and combines before its (one-row) shuffle.
    """
    cells = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in sorted(df.columns)])
    return df.select(F.xxhash64(cells).alias("_h")).agg(F.count("*").alias("n_rows"), F.bit_xor("_h").alias("_x"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_s")).select(
        F.lit(name).alias("component"), "n_rows", F.sha2(F.concat_ws(":", "n_rows", "_x", "_s"), 256).alias("digest")
    )


def run_signature(components: DataFrame) -> DataFrame:
    """One signature over all component digests, in order of their names."""
    return components.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("component", "digest"))), lambda c: F.concat_ws("=", c["component"], c["digest"])), "\n"), 256).alias("signature"), F.count("*").alias("n_components"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """component and what became of it between two runs: same, changed, added or removed."""
    j = before.select("component", F.col("digest").alias("_b")).join(after.select("component", F.col("digest").alias("_a")), "component", "full")
    return j.select("component", F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") == F.col("_b"), "same").otherwise("changed").alias("state"))
