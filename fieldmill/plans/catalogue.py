"""All registered queries of the analytics operators, with the SQL they are held against."""

from __future__ import annotations

from . import gate_queries, graph_queries, language_queries, layout_queries, logbook_queries, practice_queries, record_queries, series_queries, text_queries, trend_queries  # noqa: F401  registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
