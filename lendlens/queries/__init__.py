"""Every operator as a query over the given tables, with the SQL it has to agree with."""

from __future__ import annotations

from importlib import import_module

from lendlens.queries.registry import ORACLES, QUERIES

for _part in ("rates", "fairness", "features", "cleaning", "ordering", "profiling", "models", "landing", "pipeline"):
    import_module(f"lendlens.queries.{_part}")

__all__ = ["ORACLES", "QUERIES"]
