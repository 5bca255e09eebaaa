"""What changed between consecutive full snapshots, by invertible Bloom lookup tables.

The source is read once (and once more for its rows a version): a row delivered twice must count once, so the rows are
shuffled once by version and hash bucket and kept in a checkpoint. Each snapshot is
reduced to one lookup table per bucket, built beside its own rows. The tables of two
consecutive snapshots are subtracted; what is left holds only the difference, and
peeling lists its (key, value) hashes. Between snapshots only table cells cross the
network, about half a cell a row.

A key is known by 128 bits of hash, so that keys of one version do not meet. Buckets
that do not peel are built again, enlarged, from the kept rows; buckets that still
fail after the last enlargement are compared row by row, so no change is lost.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantora.functions.numbers import canonical_number
from quantora.operators.adjacent import previous_row
from quantora.session import cut_lineage

#: Rows a bucket is meant to hold, cells per row of it, and cells of one third at least.
BUCKET_ROWS, CELLS_PER_ROW, LEAST_THIRD = 256, 0.5, 8
#: Each enlargement multiplies the cells by this; after so many a bucket is compared directly.
ENLARGE, ROUNDS = 4, 3
HASHES = 3
_SUMS = ("_k", "_k2", "_v", "_c")
_MASK = (1 << 64) - 1


def consecutive_versions(versions: DataFrame) -> DataFrame:
    """Pairs of versions that follow each other by ``version_no`` within a project.

    Columns: project_id, version_no (of the later), prev_id, next_id, same_digest. A
    (project, version_no) delivered twice counts once, as the row with the smaller
    id. Rows without project, number or id are left out.
    """
    rows = versions.select(
        F.col("project_id").cast("bigint").alias("project_id"),
        F.col("version_no").cast("int").alias("version_no"),
        F.col("id").cast("bigint").alias("id"),
        F.col("snapshot_sha256").cast("string").alias("sha"),
    ).dropna(subset=["project_id", "version_no", "id"])
    single = rows.groupBy("project_id", "version_no").agg(F.min(F.struct("id", "sha")).alias("v")).select(
        "project_id", "version_no", "v.id", "v.sha"
    )
    pairs = previous_row(single, "project_id", "version_no", ["id", "sha"]).filter(F.col("prev_id").isNotNull())
    return pairs.select(
        "project_id",
        "version_no",
        "prev_id",
        F.col("id").alias("next_id"),
        F.coalesce(F.col("sha") == F.col("prev_sha"), F.lit(False)).alias("same_digest"),
    )


def _value_hash(fields: list[str]) -> Column:
    """Hash of the compared fields; notation does not count, null and empty are one value."""
    return F.xxhash64(*[F.coalesce(canonical_number(F.col(c)), F.lit("")) for c in fields])


def _keyed_items(items: DataFrame, fields: list[str]) -> DataFrame:
    """version_id, the two key hashes, value hash and the key itself of each usable snapshot row."""
    return items.select(
        F.col("version_id").cast("bigint").alias("version_id"),
        F.col("id").cast("bigint").alias("_row"),
        F.col("identity_key").cast("string").alias("identity_key"),
        F.col("occurrence").cast("int").alias("occurrence"),
        F.xxhash64("identity_key", "occurrence").alias("_k"),
        F.xxhash64(F.lit(1), "identity_key", "occurrence").alias("_k2"),
        _value_hash(fields).alias("_v"),
    ).filter(F.col("version_id").isNotNull() & F.col("identity_key").isNotNull() & F.col("occurrence").isNotNull())


def _cells(entries: DataFrame, level: int) -> DataFrame:
    """The lookup-table cells of each (version, bucket): count and XOR sums, beside the rows.

    Positions come from the hash of key and value, one per third of the
    table; cell -1 holds the digest of the whole bucket.
    """
    h = F.xxhash64("_k", "_k2", "_v", F.lit(level))
    position = lambda i: F.pmod(F.shiftrightunsigned(h, 21 * i).bitwiseAND(F.lit(0x1FFFFF)), F.col("_third").cast("bigint")) + F.col("_third") * i
    spread = entries.select(
        "version_id",
        "_bucket",
        "_third",
        "_k",
        "_k2",
        "_v",
        F.xxhash64("_v", "_k", "_k2").alias("_c"),
        F.explode(F.array(F.lit(-1).cast("bigint"), *[position(i).cast("bigint") for i in range(HASHES)])).alias("_cell"),
    )
    return spread.groupBy("version_id", "_bucket", "_third", "_cell").agg(F.count("*").alias("_n"), *_xor_sums())


def _xor_sums() -> list[Column]:
    return [F.bit_xor(c).alias(c) for c in _SUMS]


def _subtract(cells: DataFrame, sides: DataFrame) -> DataFrame:
    """Cells of the later snapshot minus cells of the earlier; one row per (pair, bucket) with what is left."""
    signed = cells.join(sides, "version_id").select(
        "pair_id", "_bucket", "_third", "_cell", (F.col("_n") * F.col("sign")).alias("_n"), *_SUMS
    )
    left = (
        signed.groupBy("pair_id", "_bucket", "_third", "_cell")
        .agg(F.sum("_n").alias("_n"), *_xor_sums())
        .filter((F.col("_n") != 0) | (F.col("_k") != 0) | (F.col("_k2") != 0) | (F.col("_v") != 0) | (F.col("_c") != 0))
    )
    return left.groupBy("pair_id", "_bucket", "_third").agg(F.collect_list(F.struct("_cell", "_n", *_SUMS)).alias("cells"))


def _hash_longs(*longs: int) -> int:
    """Spark's xxhash64 of longs: XXH64 of each value's eight bytes, seeded by the hash before."""
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=seed)
    return seed


def _hash_level(level: int, *longs: int) -> int:
    """As :func:`_hash_longs` with a trailing 32-bit level, as the cells hash it."""
    return xxhash.xxh64_intdigest(struct.pack("<i", level), seed=_hash_longs(*longs))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def peel(third: int, cells: list[tuple[int, ...]], level: int) -> list[tuple[int, int, int, int]] | None:
    """The (key hashes, value hash, sign) of a subtracted table, or None if it does not peel.

    ``cells``: (cell, count, XOR of the first and second key hash, of the value and of
    the check). A list is returned only if every cell came out empty and the bucket's
    digest (cell -1) is explained.
    """
    table = {c: list(sums) for c, *sums in cells if c >= 0}
    digest = next((list(sums) for c, *sums in cells if c < 0), [0] * 5)
    out, queue = [], list(table)
    while queue:
        cell = table.get(queue.pop())
        if cell is None or cell[0] not in (1, -1):
            continue
        sign, k, k2, v, check = cell
        if _signed(_hash_longs(v, k, k2)) != check:
            continue
        h = _hash_level(level, k, k2, v)
        places = [((h >> (21 * i)) & 0x1FFFFF) % third + third * i for i in range(HASHES)]
        for c in (*(table.setdefault(at, [0] * 5) for at in places), digest):
            c[0] -= sign
            for j, x in enumerate((k, k2, v, check), 1):
                c[j] ^= x
        queue += places
        out.append((k, k2, v, sign))
        if len(out) > 4 * len(table) + 4:
            return None
    clean = not any(x for c in table.values() for x in c) and not any(digest)
    return out if clean else None


def _peel_batches(level: int):
    """An Arrow mapper from subtracted tables to recovered keys; a null key marks a bucket that failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for pair, bucket, third, cells in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                got = peel(third, [tuple(c.values()) for c in cells], level)
                rows += [(pair, bucket, None, None, None)] if got is None else [(pair, bucket, k, k2, s) for k, k2, _, s in got]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in cols], names=["pair_id", "_bucket", "_k", "_k2", "sign"]
            )

    return run


_PEELED = "pair_id bigint, _bucket bigint, _k bigint, _k2 bigint, sign bigint"


def snapshot_changes(versions: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("unit_price", "amount"), bucket_rows: int = BUCKET_ROWS, cells_per_row: float = CELLS_PER_ROW, rounds: int = ROUNDS) -> DataFrame:
    """Records added, removed or changed between consecutive snapshots of each project.

    Result: project_id, version_no (of the later snapshot), identity_key, occurrence,
    change_kind (``added``, ``removed`` or ``changed``).

    Defined cases: a row delivered twice counts once (the row with the smaller id, if
    they differ); null and empty values are the same; notation and currency signs do
    not count; snapshots with the same non-null digest hold no change and are not
    read; a version without rows is an empty snapshot; rows without version, key or
    occurrence are left out; other columns are not read; empty tables give no rows.
    """
    fields = list(fields)
    pairs = cut_lineage(
        consecutive_versions(versions)
        .filter(~F.col("same_digest"))
        .select("*", F.xxhash64("prev_id", "next_id").alias("pair_id"))
    )
    sides = pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.col("prev_id").alias("version_id"), F.lit(-1).alias("sign")),
                F.struct(F.col("next_id").alias("version_id"), F.lit(1).alias("sign")),
            )
        ).alias("s"),
    ).select("pair_id", "s.*")

    # Buckets of a project follow its largest snapshot, so that both sides agree.
    sizes = items.groupBy(F.col("version_id").cast("bigint").alias("version_id")).agg(F.count("*").alias("_rows"))
    of = pairs.select("project_id", F.explode(F.array("prev_id", "next_id")).alias("version_id")).distinct()
    largest = of.join(sizes, "version_id").groupBy("project_id").agg(F.max("_rows").alias("_rows"))
    buckets = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_rows") / F.lit(float(bucket_rows)))))).cast("bigint")
    active = cut_lineage(of.join(largest, "project_id").select("version_id", buckets.alias("_buckets"), "_rows"))

    entries = (
        _keyed_items(items, fields)
        .join(active, "version_id")
        .withColumn("_bucket", F.pmod(F.shiftrightunsigned("_k", 40), F.col("_buckets")))
        .withColumn(
            "_third",
            F.greatest(F.lit(LEAST_THIRD), F.ceil(F.col("_rows") / F.col("_buckets") * F.lit(cells_per_row) / F.lit(HASHES))).cast("bigint"),
        )
    )
    # The one shuffle of the rows; tables, retries and names are made from what is kept here.
    single = cut_lineage(
        entries.repartition("version_id", "_bucket")
        .groupBy("version_id", "_bucket", "_third", "_k", "_k2")
        .agg(F.min(F.struct("_row", "_v", "identity_key", "occurrence")).alias("_first"))
        .select("version_id", "_bucket", "_third", "_k", "_k2", "_first._v", "_first.identity_key", "_first.occurrence")
    )

    recovered = cut_lineage(_subtract(_cells(single, 0), sides).mapInArrow(_peel_batches(0), _PEELED))
    done = recovered.filter(F.col("_k").isNotNull())
    failed = recovered.filter(F.col("_k").isNull()).select("pair_id", "_bucket")
    scale = 1
    for level in range(1, rounds + 1):
        if failed.isEmpty():
            failed = None
            break
        scale *= ENLARGE
        again_sides = failed.join(sides, "pair_id")
        redo = single.join(again_sides.select("version_id", "_bucket").distinct(), ["version_id", "_bucket"], "left_semi")
        cells = _cells(redo.withColumn("_third", F.col("_third") * scale), level)
        left = _subtract(cells, sides).join(failed, ["pair_id", "_bucket"], "left_semi")
        recovered = cut_lineage(left.select("pair_id", "_bucket", "_third", "cells").mapInArrow(_peel_batches(level), _PEELED))
        done = done.unionByName(recovered.filter(F.col("_k").isNotNull()))
        failed = recovered.filter(F.col("_k").isNull()).select("pair_id", "_bucket")
    if failed is not None and not failed.isEmpty():
        done = done.unionByName(_compare_directly(single, failed, sides))

    kind = done.groupBy("pair_id", "_bucket", "_k", "_k2").agg(F.max(F.col("sign") > 0).alias("_in_next"), F.max(F.col("sign") < 0).alias("_in_prev"))
    named = kind.join(pairs, "pair_id").select(
        "project_id",
        "version_no",
        "_bucket",
        "_k",
        "_k2",
        F.when(F.col("_in_next"), F.col("next_id")).otherwise(F.col("prev_id")).alias("version_id"),
        F.when(F.col("_in_next") & F.col("_in_prev"), F.lit("changed"))
        .when(F.col("_in_next"), F.lit("added"))
        .otherwise(F.lit("removed"))
        .alias("change_kind"),
    )
    keys = single.select("version_id", "_bucket", "_k", "_k2", "identity_key", "occurrence")
    return named.join(keys, ["version_id", "_bucket", "_k", "_k2"]).select("project_id", "version_no", "identity_key", "occurrence", "change_kind")


def _compare_directly(single: DataFrame, failed: DataFrame, sides: DataFrame) -> DataFrame:
    """The exact way for buckets that no lookup table resolved: compare their rows."""
    rows = single.join(sides, "version_id").join(failed, ["pair_id", "_bucket"], "left_semi")
    differing = rows.groupBy("pair_id", "_bucket", "_k", "_k2", "_v").agg(F.sum("sign").alias("sign")).filter(F.col("sign") != 0)
    return differing.select("pair_id", "_bucket", "_k", "_k2", F.col("sign").cast("bigint").alias("sign"))
