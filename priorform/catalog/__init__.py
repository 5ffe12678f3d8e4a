"""Registered queries over the sample tables, with their SQL twins."""

from __future__ import annotations

from priorform.catalog.registry import ORACLES, QUERIES
from priorform.catalog import (  # noqa: F401  (imported to register)
    assembly,
    cleaning,
    models,
    outcomes,
    statistics,
    storage,
    summaries,
    temporal,
)

__all__ = ["ORACLES", "QUERIES"]
