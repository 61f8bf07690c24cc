"""All queries of the log part by name, with their DuckDB SQL."""

from . import ingest_queries, log_queries, schema_queries, stream_queries, usage_queries  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
