"""All queries of the core and their oracles, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("settlement_data", "aggregates", "sequences", "joins", "rules", "grouping", "documents", "control", "predicates", "ledgers", "streams")


def gather(modules: tuple[str, ...] = _MODULES) -> tuple[dict, dict]:
    """(queries, oracles) of the plan modules; names must not repeat."""
    queries: dict = {}
    oracles: dict = {}
    for name in modules:
        module = import_module(f"quantora.plans.{name}")
        if twice := queries.keys() & module.QUERIES.keys():
            raise ValueError(f"queries defined twice: {sorted(twice)}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
