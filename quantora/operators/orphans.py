"""References to records that do not exist, are deleted, or arrived later.

All references of all child tables form one stream, all parent rows another. Both
are hash co-partitioned on ``(parent, key)``, sorted, and merged linearly (a Spark
sort-merge join); the parent's validity interval ``[arrived_at, deleted_at)`` then
separates the reasons. Hot keys are split by AQE: both sides of the join start from
their own exchange, which is what its skew rule needs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantora.session import cut_lineage

REASONS = ("missing", "deleted", "late")


@dataclass(frozen=True)
class Parent:
    """A referenced table: its key, the time a row became valid, the time it ended."""

    name: str
    rows: DataFrame
    key: str
    arrived_at: str
    deleted_at: str


@dataclass(frozen=True)
class Child:
    """A referring table. ``fields`` maps each reference column to its parent's name."""

    name: str
    rows: DataFrame
    record_id: str
    arrived_at: str
    fields: dict[str, str]
    extra: dict[str, Column] = field(default_factory=dict)


def parent_validity(parents: list[Parent]) -> DataFrame:
    """One row per ``(parent, key)``: earliest arrival of its live rows, and whether any is live.

    A key delivered in several rows is deleted only when each of them is.
    """
    stream = None
    for p in parents:
        live = F.col(p.deleted_at).isNull()
        rows = p.rows.select(
            F.lit(p.name).alias("_parent"),
            F.col(p.key).cast("bigint").alias("_key"),
            F.when(live, F.col(p.arrived_at)).alias("_arrived"),
            live.alias("_live"),
        ).filter(F.col("_key").isNotNull())
        stream = rows if stream is None else stream.unionByName(rows)
    return stream.groupBy("_parent", "_key").agg(
        F.min("_arrived").alias("_valid_from"), F.max("_live").alias("_live")
    )


def reference_stream(children: list[Child]) -> DataFrame:
    """One row per non-null reference; each child table is scanned once for all its fields."""
    stream = None
    extras = sorted({name for c in children for name in c.extra})
    for c in children:
        base = [
            F.lit(c.name).alias("table_name"),
            F.col(c.record_id).alias("record_id"),
            F.col(c.arrived_at).alias("_recorded"),
            *[c.extra.get(n, F.lit(None).cast("bigint")).alias(n) for n in extras],
        ]
        refs = F.array(
            *[
                F.struct(
                    F.lit(name).alias("field_name"),
                    F.lit(parent).alias("_parent"),
                    F.col(name).cast("bigint").alias("_key"),
                )
                for name, parent in c.fields.items()
            ]
        )
        rows = c.rows.select(*base, F.explode(refs).alias("_ref")).select(
            "table_name", "record_id", "_recorded", *extras, "_ref.*"
        ).filter(F.col("_key").isNotNull())
        stream = rows if stream is None else stream.unionByName(rows)
    return stream


def classify_references(children: list[Child], parents: list[Parent]) -> DataFrame:
    """Every non-null reference with ``reason`` (null where the reference is valid).

    Columns: table_name, field_name, record_id, key, reason, and the children's
    extra columns. Defined cases: a null reference is no reference and gives no row;
    an empty parent table makes every reference ``missing``; a repeated child row
    gives a repeated result row; a null arrival time on either side is never
    ``late``; columns other than those named by the specs are not read.
    """
    validity = cut_lineage(parent_validity(parents))
    refs = reference_stream(children)
    merged = refs.hint("merge").join(validity, ["_parent", "_key"], "left")
    reason = (
        F.when(F.col("_live").isNull(), F.lit("missing"))
        .when(~F.col("_live"), F.lit("deleted"))
        .when(F.col("_valid_from") > F.col("_recorded"), F.lit("late"))
    )
    extras = [c for c in refs.columns if c not in ("table_name", "field_name", "record_id", "_recorded", "_parent", "_key")]
    return merged.select("table_name", "field_name", "record_id", F.col("_key").alias("key"), reason.alias("reason"), *extras)


def find_orphans(children: list[Child], parents: list[Parent]) -> DataFrame:
    """The orphan references only: table_name, field_name, record_id, reason, without duplicate rows."""
    found = classify_references(children, parents).filter(F.col("reason").isNotNull())
    return found.select("table_name", "field_name", "record_id", "reason").distinct()


def orphan_report(children: list[Child], parents: list[Parent], period: str) -> DataFrame:
    """References and orphans counted per table, field and ``period`` (an extra column of the children)."""
    rows = classify_references(children, parents)
    counts = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REASONS]
    return rows.groupBy("table_name", "field_name", F.col(period).alias("period_id")).agg(
        F.count("*").alias("n_references"), *counts
    )
