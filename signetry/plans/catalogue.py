"""All queries of the core library and their SQL, gathered from the plan modules."""

from __future__ import annotations

from . import cleaning, graphs, measures, mitigation, training

MODULES = [cleaning, graphs, measures, mitigation, training]
FLAGSHIP = measures.polarization_score


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
