"""Registered queries and their SQL oracles over the given tables."""

from __future__ import annotations

import importlib

from lexispark.catalog.registry import ORACLES, QUERIES

_MODULES = ["corpus", "textual", "encoding", "dialogue", "numeric", "graphs", "exchange", "segmentation", "models"]

for _name in _MODULES:
    importlib.import_module(f"lexispark.catalog.{_name}")

__all__ = ["QUERIES", "ORACLES"]
