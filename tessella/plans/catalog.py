"""All queries by name with their SQL."""

from __future__ import annotations

import importlib

from tessella.queries import ORACLE, QUERIES

FLAGSHIP = "flagship_group_labels"
MODULES = ("stencil", "spatial", "sequences", "graphs", "temporal", "kernels", "streams", "more", "extra", "video")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessella.queries.{name}")


def queries() -> dict:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLE
