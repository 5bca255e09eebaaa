"""Adjacent rows of ordered groups without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def previous_row(df: DataFrame, key: str, order: str, carry: list[str], block: int = 1024) -> DataFrame:
    """Add ``prev_<c>`` of the preceding row by integer ``order`` within ``key``, for each carried column.

    ``(key, order)`` must be unique. A window over a hot key would sort all its rows
    in one task; here each window holds one block of ``block`` consecutive order
    values, and only one summary row per block is ordered per key to carry values
    across block borders. First rows of a key have nulls.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    payload = F.struct(*[F.col(c) for c in carry])
    within = Window.partitionBy(key, "_block").orderBy(order)
    rows = blocked.withColumn("_prev", F.lag(payload).over(within))
    last = blocked.groupBy(key, "_block").agg(F.max_by(payload, F.col(order)).alias("_last"))
    across = Window.partitionBy(key).orderBy("_block")
    carried = last.select(key, "_block", F.lag("_last").over(across).alias("_carried"))
    joined = rows.join(carried, [key, "_block"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_carried"))
    return joined.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in carry])
