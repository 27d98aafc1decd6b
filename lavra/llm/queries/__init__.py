"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8")


def _each(what: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        try:
            module = import_module(f"{__name__}.{name}")
        except ModuleNotFoundError as missing:
            if missing.name != f"{__name__}.{name}":
                raise
            continue
        found |= getattr(module, what, {})
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _each("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _each("ORACLES")
