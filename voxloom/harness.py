"""Queries over the test tables, each with the SQL that an independent engine runs for the same rows."""

from __future__ import annotations

from .plans import queries_bindings, queries_files, queries_relational, queries_samples, queries_speech, queries_text, queries_views, queries_writes
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "queries_bindings", "queries_files", "queries_relational", "queries_samples", "queries_speech", "queries_text", "queries_views", "queries_writes"]
