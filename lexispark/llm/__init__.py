"""Operators for preparing training text, with their registered queries.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries when the package is there.
"""

from __future__ import annotations

import importlib

from lexispark.llm.registry import ORACLES, QUERIES

_MODULES = ["bpe_trie", "pu_quality", "toxicity", "token_store", "weak_quality", "site_lines", "perspectives", "spaced_seeds", "jaccard_join", "substring_dedup", "turn_repair", "merkle_manifest", "minhash_groups"]

for _name in _MODULES:
    importlib.import_module(f"lexispark.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
