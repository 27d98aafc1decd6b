"""Registered queries: compositions of operators over the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES: tuple[str, ...] = ("text", "retrieval", "metrics", "curation", "evaluation", "assembly")


def _each(what: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), what)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _each("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _each("ORACLES")
