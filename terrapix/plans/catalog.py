"""All registered queries, and the flagship."""

from __future__ import annotations

from . import aggregates, bands, chains, extras, grid, kernels, polygons, tables  # noqa: F401  each registers its queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]

flagship = aggregates.segstats_table
