"""Registered queries of the trajectory operators, and their SQL."""

from __future__ import annotations

from . import evaluation, geometry, learning, sync  # noqa: F401
from .common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
