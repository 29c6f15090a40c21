"""Queries of the survey operators and their SQL."""

from __future__ import annotations

from plumbline.plans import control_queries, keyed_queries, quality_queries, record_queries, review_queries, sequence_queries, snapshot_queries, source_queries, surface_queries  # noqa: F401
from plumbline.plans.bindings import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
