"""All registered queries of the library."""

from __future__ import annotations

from . import changes, composite, lint, notes, retrieval, structure  # noqa: F401 - they register their queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
