"""Runnable queries, grouped like the operator inventory."""
from __future__ import annotations

import importlib

GROUPS = ("lake", "schemas", "filters", "joins", "aggregates", "kpis", "windows", "ranking", "scalars",
          "quality", "forecasting", "pricing", "recommendation", "evaluation")


def load():
    """Imports every group and returns the registry module."""
    for group in GROUPS:
        try:
            importlib.import_module(f"marketlens.catalog.{group}")
        except ModuleNotFoundError as error:
            if error.name != f"marketlens.catalog.{group}":
                raise
    return importlib.import_module("marketlens.catalog.base")
