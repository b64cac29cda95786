"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

import importlib

MODULES = ("rollups", "pairs", "sequences", "texts", "groups", "streams", "logfiles", "contexts", "commands", "shells", "reports")


def _of(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        found = getattr(importlib.import_module(f"{__package__}.{name}"), kind)
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict:
    return _of("QUERIES")


def oracle_sql() -> dict:
    return _of("ORACLE_SQL")
