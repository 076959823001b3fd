"""Registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from quarryline.plans import audits, code, graphs, location, operations, pointers, retrieval, textual, triage

_PARTS = (triage, retrieval, textual, graphs, audits, operations, code, pointers, location)


def queries() -> dict:
    return {k: f for p in _PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _PARTS for k, s in p.ORACLE.items()}
