"""Registered queries: each a (spark, folder) -> DataFrame, most with equivalent DuckDB SQL."""

from __future__ import annotations

from lodestrata.queries import activity, archive, conversation, evidence, jobs, relational, search, text
from lodestrata.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "activity", "archive", "conversation", "evidence", "jobs", "relational", "search", "text"]
