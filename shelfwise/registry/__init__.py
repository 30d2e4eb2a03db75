"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from shelfwise.registry.core import ORACLES, QUERIES

for _section in ("scalars", "tables", "serving", "text", "recommend", "models", "files", "streams"):
    import_module(f"shelfwise.registry.{_section}")

__all__ = ["ORACLES", "QUERIES"]
