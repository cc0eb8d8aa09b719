"""Import every module that registers queries."""

from __future__ import annotations

import importlib
import pkgutil

from helpweave.checks import registry


def load_all():
    package = importlib.import_module("helpweave.checks")
    for info in pkgutil.iter_modules(package.__path__):
        if info.name.startswith("q_"):
            importlib.import_module(f"helpweave.checks.{info.name}")
    return registry.QUERIES, registry.ORACLES
