"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("packing", "language", "jaccard", "urls", "dedup", "segmentation", "quality", "store", "chat", "toxicity", "divergence", "trie", "lines")


def _of(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), kind, {})
    return out


def queries() -> dict:
    return _of("QUERIES")


def oracle_sql() -> dict:
    return _of("ORACLE_SQL")
