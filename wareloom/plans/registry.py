"""Registry of the bound query catalogue: name -> Spark builder, and name -> oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

_MODULES = ("q_merges", "q_columns", "q_quality", "q_runlog", "q_reports", "q_catalogue", "q_text", "q_flows",
            "q_io", "q_stream", "q_edges", "q_values", "q_files", "q_targets")


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> tuple[dict, dict]:
    for m in _MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{m}":
                raise
    return QUERIES, ORACLE
