"""Imports every module that registers queries."""

from __future__ import annotations

from cliploom.plans import q_gate, q_joins, q_more, q_sources, q_splits, q_stats, q_text  # noqa: F401
from cliploom.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "WER-3"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
