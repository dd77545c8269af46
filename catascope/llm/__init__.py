"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    """The query modules: op01, op02 and so on."""
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if m.name.startswith("op")]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _modules() for k, q in m.ORACLES.items()}
