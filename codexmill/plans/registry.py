"""All registered queries and their SQL."""

from __future__ import annotations

from . import engine, integrity, library, lookups, sources

MODULES = [integrity, lookups, library, sources, engine]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
