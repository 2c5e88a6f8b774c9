"""The registered queries on the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from stratalog.plans import queries_media, queries_more, queries_stats, queries_tags, queries_text
from stratalog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_media", "queries_more", "queries_stats", "queries_tags", "queries_text"]
