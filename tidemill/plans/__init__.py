"""The registered queries: a module each for a family of operators, with QUERIES and SQL by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

FAMILIES = ("advantages", "losses", "offpolicy", "metrics", "tables", "breadth", "depth")


def queries() -> dict[str, Callable]:
    return {k: f for name in FAMILIES for k, f in import_module(f"tidemill.plans.{name}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for name in FAMILIES for k, s in import_module(f"tidemill.plans.{name}").SQL.items()}
