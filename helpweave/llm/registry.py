"""Queries of this subpackage: the registered functions and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def load() -> tuple[dict, dict]:
    package = importlib.import_module("helpweave.llm")
    for info in pkgutil.iter_modules(package.__path__):
        if info.name.startswith("op"):
            importlib.import_module(f"helpweave.llm.{info.name}")
    return QUERIES, ORACLES
