"""All registered queries of the event-log operators and their SQL; importing it fills both."""

from __future__ import annotations

from . import export_queries, ingest_queries, whole_queries
from .queries import ORACLES, QUERIES

#: Where queries are defined, besides ``queries``.
MODULES = (export_queries, ingest_queries, whole_queries)
__all__ = ["MODULES", "ORACLES", "QUERIES"]
