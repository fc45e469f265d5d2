"""Loads every module that registers driver queries."""

from __future__ import annotations

import importlib

from touchstone.plans.registry import ORACLES, QUERIES

_MODULES = [
    "agreement_queries", "operating_queries", "group_queries", "resample_queries", "model_queries", "text_queries", "graph_queries",
    "plugin_queries", "source_queries",
]

for _name in _MODULES:
    importlib.import_module(f"touchstone.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
