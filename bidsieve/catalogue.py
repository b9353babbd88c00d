"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES, Query

_MODULES = ("scalars", "listing", "lookups", "duplicates", "retrieval", "scoring", "people", "aggregates", "upkeep", "web", "streams")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"bidsieve.queries.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
