"""All queries of the core, by name, with their SQL twins."""

from __future__ import annotations

from . import algorithms, build, questions, records, retrieval

_MODULES = [questions, build, retrieval, algorithms, records]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _MODULES for k, q in m.ORACLE.items()}
