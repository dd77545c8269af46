"""Registered queries and their SQL, by operator group."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if not m.name.startswith("_")]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _modules() for k, q in m.ORACLES.items()}
