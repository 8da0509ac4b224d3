"""All registered queries of the log store and the archive."""

from __future__ import annotations

from . import archive_queries, log_queries, stream_queries, text_queries  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
