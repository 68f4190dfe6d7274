"""Registered queries by area; ``load`` imports them all and returns the registry."""

from __future__ import annotations

import importlib

from .registry import QUERIES, Query

MODULES: tuple[str, ...] = ("genotypes", "overlaps", "aggregates", "phase", "ranking", "scalars", "evidence", "observed", "clinical", "statistics", "methyl", "quality")


def load() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return QUERIES
