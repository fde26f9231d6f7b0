"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import alignment, evaluation, features, governance, grounding, integrity, learning, metrics, policy, reports, retrieval, statistics, systems, tables  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
