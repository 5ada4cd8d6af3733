"""Registry of queries and oracles of the core library."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("prep", "relational", "fields", "analytic", "shocks", "statistics", "inference", "files", "published")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        part = getattr(import_module(f"pitchloom.plans.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
