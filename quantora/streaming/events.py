"""Stock Structured Streaming over the event table: windows, sessions and state. An extension, no parity claim."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events of a parquet file or folder as a stream, with event time."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if path.endswith(".parquet") and not path.startswith("hdfs") and os.path.isfile(path):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, write each result once, and return the results as a table.

    Results and the stream's log lie in the session's shared checkpoint folder, so a
    restarted driver goes on where it ended.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    else:
        q = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out"))
            .option("checkpointLocation", f"{base}/log")
            .trigger(availableNow=True)
            .start()
        )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _timed(events: DataFrame) -> DataFrame:
    """Event time as an instant, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per window and type; windows close once the watermark has passed them."""
    g = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events not further apart than the gap."""
    g = _timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_balance(events: DataFrame) -> DataFrame:
    """A custom stateful operator: each user's running count and sum, carried in state from batch to batch."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, total double", "n bigint, total double", "update", "NoTimeout")
