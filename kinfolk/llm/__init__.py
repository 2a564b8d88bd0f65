"""Operators for preparing training text. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

MODULES = ("quality", "secrets", "mixing", "sharding", "neardup", "packing", "toxicity", "substrings", "html", "neighbours")


def _gather(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"kinfolk.llm.{m}"), name)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return {k: v() if callable(v) else v for k, v in _gather("ORACLES").items() if v is not None}
