"""Queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from .base import ORACLES, QUERIES
from . import graph_queries, motion_queries, prototype_queries, score_queries, selection_queries, sweep_queries, window_queries  # noqa: F401  they register themselves

__all__ = ["ORACLES", "QUERIES"]
