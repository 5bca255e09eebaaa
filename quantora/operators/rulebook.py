"""A catalogue of rules over the frames of a project, and the runner that keeps their failures apart.

A rule names the frames it reads and maps them to findings (rule_id, severity,
subject). The runner skips rules whose frames are absent or that are disabled, and a
rule that fails takes none of the others with it: its row in the coverage says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.session import cut_lineage

#: Rules whose jobs run side by side.
AT_ONCE = 6
FINDING = "rule string, rule_id string, severity string, subject string"
COVERAGE = "rule string, status string, n_findings bigint, reason string"


@dataclass(frozen=True)
class Rule:
    """A named rule and the frames that it reads, in the order of its arguments."""

    name: str
    frames: tuple[str, ...]
    find: Callable[..., DataFrame]


def finding(rows: DataFrame, rule_id: Column | str, severity: Column | str, *subject: str | Column) -> DataFrame:
    """Findings of rows; the parts of a subject are joined by ``/``."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(as_col(rule_id).alias("rule_id"), as_col(severity).alias("severity"), F.concat_ws("/", *[F.col(s) if isinstance(s, str) else s for s in subject]).alias("subject"))


def run(spark: SparkSession, rules: Iterable[Rule], frames: dict[str, DataFrame], disabled: frozenset[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """(findings, coverage). Frames are read once; the findings of each rule are kept, so that counting them costs no second run.

    coverage: rule, status (``executed``, ``skipped`` or ``failed``), n_findings, reason.
    """
    rules = list(rules)
    wanted = {f for r in rules if r.name not in disabled for f in r.frames}
    kept = {k: cut_lineage(v) for k, v in frames.items() if k in wanted}

    def judge(rule: Rule) -> tuple[DataFrame | None, tuple]:
        absent = [f for f in rule.frames if f not in kept]
        if rule.name in disabled or absent:
            return None, (rule.name, "skipped", None, "disabled" if rule.name in disabled else f"no {', '.join(absent)}")
        try:
            rows = cut_lineage(rule.find(*[kept[f] for f in rule.frames]).select(F.lit(rule.name).alias("rule"), "rule_id", "severity", "subject"))
            return rows, (rule.name, "executed", rows.count(), None)
        except (PySparkException, ValueError) as e:
            return None, (rule.name, "failed", None, type(e).__name__)

    # Rules do not depend on each other: their jobs share the cluster.
    with ThreadPoolExecutor(AT_ONCE) as pool:
        judged = list(pool.map(judge, rules))
    findings = spark.createDataFrame([], FINDING)
    for rows, _ in judged:
        if rows is not None:
            findings = findings.unionByName(rows)
    return findings, spark.createDataFrame([c for _, c in judged], COVERAGE)


def coverage_status(coverage: DataFrame) -> DataFrame:
    """One row: expected, executed, skipped and failed rules, and ``complete``, ``partial``, ``failed`` or ``none``."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    g = coverage.agg(F.count("*").alias("expected"), of("executed"), of("skipped"), of("failed"))
    status = F.when(F.col("executed") == 0, "none").when(F.col("failed") > 0, "failed").when(F.col("skipped") > 0, "partial").otherwise("complete")
    return g.withColumn("status", status)
