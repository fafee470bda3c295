"""Registered queries over the given tables and their SQL counterparts."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = ("collections", "physics", "reports", "chain", "classifier")


def load() -> ModuleType:
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"suite.{name}")
    return importlib.import_module("suite.registry")
