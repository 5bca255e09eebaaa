"""Cell formulas: references, column letters, dependency edges and transitive impact."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantora.operators.lineage import table_digest
from quantora.session import cut_lineage

_REFERENCE = re.compile(r"(?:'([^']+)'|([A-Za-z_一-鿿][\w一-鿿]*))?(!)?\$?([A-Z]{1,3})\$?([1-9]\d*)(?::\$?([A-Z]{1,3})\$?([1-9]\d*))?")
#: Cells a range may span before its formula is called incomplete.
MOST_CELLS = 10_000
# Functions whose references are not known before they run.
OPAQUE = ("INDIRECT", "OFFSET", "INDEX", "CHOOSE")


def column_number(letters: str) -> int:
    """A to ZZZ as 1 to 18278."""
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def column_letters(n: Column) -> Column:
    """1 to 18278 as A to ZZZ."""
    letter = lambda x: F.char((x + 65).cast("int"))
    one = letter(n - 1)
    two = F.concat(letter(F.floor((n - 27) / 26)), letter(F.pmod(n - 1, F.lit(26))))
    three = F.concat(letter(F.floor((n - 703) / 676)), letter(F.pmod(F.floor((n - 27) / 26), F.lit(26))), letter(F.pmod(n - 1, F.lit(26))))
    return F.when(n.between(1, 26), one).when(n.between(27, 702), two).when(n.between(703, 18278), three)


def references(formula: str, sheet: str) -> tuple[list[tuple[str, int, int]], str]:
    """((sheet, row, column) of every cell a formula reads, status): ``ok``, ``opaque`` or ``incomplete``."""
    if not formula or not formula.startswith("="):
        return [], "not a formula"
    text = re.sub(r'"[^"]*"', "", formula)
    if any(re.search(rf"\b{f}\s*\(", text, re.I) for f in OPAQUE):
        return [], "opaque"
    cells: list[tuple[str, int, int]] = []
    status = "ok"
    for m in _REFERENCE.finditer(text):
        quoted, bare, bang, c1, r1, c2, r2 = m.groups()
        if bare and not bang:
            if text[m.end() : m.end() + 1] == "(":
                continue
            continue
        own = (quoted or bare) if bang else sheet
        a, b = column_number(c1), column_number(c2) if c2 else column_number(c1)
        low, high = int(r1), int(r2) if r2 else int(r1)
        size = (abs(b - a) + 1) * (abs(high - low) + 1)
        if size > MOST_CELLS:
            status = "incomplete"
            continue
        cells += [(own, r, c) for r in range(min(low, high), max(low, high) + 1) for c in range(min(a, b), max(a, b) + 1)]
    return sorted(set(cells)), status


def formula_edges(formulas: DataFrame) -> DataFrame:
    """source_sheet, source_row, source_col -> sheet, row, col (the cell that reads it); opaque formulas give no edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sheet, row, col, formula in zip(pdf["sheet"], pdf["row"], pdf["col"], pdf["formula"], strict=True):
                found, status = references(formula, sheet)
                if status == "ok":
                    rows += [(*c, sheet, row, col) for c in found]
            yield pd.DataFrame(rows, columns=["source_sheet", "source_row", "source_col", "sheet", "row", "col"])

    return formulas.select("sheet", "row", "col", "formula").mapInPandas(run, "source_sheet string, source_row int, source_col int, sheet string, row int, col int")


def formula_report(formulas: DataFrame) -> DataFrame:
    """sheet, row, col, status and n_references of every formula, also of those that give no edges: opaque ones, and ranges above MOST_CELLS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sheet, row, col, formula in zip(pdf["sheet"], pdf["row"], pdf["col"], pdf["formula"], strict=True):
                found, status = references(formula, sheet)
                rows.append((sheet, row, col, status, len(found)))
            yield pd.DataFrame(rows, columns=["sheet", "row", "col", "status", "n_references"])

    return formulas.select("sheet", "row", "col", "formula").mapInPandas(run, "sheet string, row int, col int, status string, n_references int")


def direct_dependents(edges: DataFrame) -> DataFrame:
    """Every cell that formulas read, with the number of cells that read it."""
    return edges.distinct().groupBy("source_sheet", "source_row", "source_col").agg(F.count("*").alias("n_dependents"))


def is_valid_for(fingerprint: str, formulas: DataFrame) -> bool:
    """Whether a graph with this fingerprint still belongs to the formulas."""
    return graph_fingerprint(formulas).first()["digest"] == fingerprint


def graph_fingerprint(formulas: DataFrame) -> DataFrame:
    """One row with the digest of all formulas and their places, whatever their order; it changes when any of them does."""
    return table_digest(formulas.select("sheet", "row", "col", "formula"), "formulas").select("n_rows", "digest")


def impact(edges: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target", max_depth: int | None = None) -> DataFrame:
    """node, depth and ``complete`` of everything that a seed node reaches, breadth first; ``seeds`` has ``node``.

    Each level is one join of the newly reached nodes with the edges; nodes reached
    before are left out, so cycles end. Without ``max_depth`` nothing is left out; with
    it ``complete`` is false where nodes beyond it are not looked for.
    """
    links = cut_lineage(edges.select(F.col(source).alias("node"), F.col(target).alias("_next")).distinct())
    reached = cut_lineage(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = reached
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = front.join(links, "node").select(F.col("_next").alias("node")).distinct().join(reached, "node", "left_anti").withColumn("depth", F.lit(depth))
        front = cut_lineage(new)
        if front.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(front))
    ended = front.join(links, "node").select(F.col("_next").alias("node")).join(reached, "node", "left_anti").isEmpty()
    return reached.withColumn("complete", F.lit(ended))
