"""Registered queries, each next to its check SQL."""

from __future__ import annotations

from importlib import import_module

from brickline.catalog.registry import ORACLES, QUERIES, resolve_oracles

# Registration modules, in survey order.
SECTIONS = [
    "scans", "merges", "scalars", "filters", "reshapes", "joins", "aggregates", "windows", "topk",
    "models", "serving", "streams",
]

for _name in SECTIONS:
    import_module(f"brickline.catalog.{_name}")
resolve_oracles()

__all__ = ["ORACLES", "QUERIES"]
