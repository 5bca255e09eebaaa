"""Session defaults and lineage control shared by all operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings every operator is written against. AQE does the run-time work the
#: operators rely on: splitting skewed merge-join partitions, coalescing small
#: shuffle partitions, and broadcasting only sides whose measured size allows it.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Checkpoints are deleted when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; ``conf`` (dots as ``__``) overrides them."""
    builder = SparkSession.builder.master(master).appName("quantora")
    settings = dict(DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set from ``spark.checkpoint.dir``.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only where that
    setting is absent (tests, a laptop) a folder of this machine is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not shared:
        shared = os.path.join(tempfile.gettempdir(), f"quantora-checkpoints-{os.getpid()}")
    sc.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint and return it.

    Used where a plan would otherwise be computed several times (iterations,
    branches) or where a join side must start from its own exchange so that AQE may
    split skewed partitions. Reliable means: the blocks survive lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside drops its shuffle files as soon as it is done.

    Otherwise they stay until the driver's JVM happens to collect its garbage, so that
    a second job over the same rows can find the first one's files still on disk.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def default_parallelism(spark: SparkSession) -> int:
    """The number of task slots the session reports."""
    return max(1, spark.sparkContext.defaultParallelism)
