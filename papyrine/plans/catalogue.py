"""All queries of the library and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with QUERIES (name -> callable) and SQL (name -> text).
MODULES: tuple[str, ...] = ("retrieval", "relational", "evaluation", "decisions", "agent", "rounds")


def _merged(field: str) -> dict:
    out: dict = {}
    for m in MODULES:
        for name, value in getattr(importlib.import_module(f"papyrine.plans.{m}"), field).items():
            if name in out:
                raise ValueError(f"two queries named {name}")
            out[name] = value
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
