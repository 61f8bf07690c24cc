"""The registry of queries, and the SQL that derives the log in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir) with its SQL."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = BASE + sql if not sql.lstrip().startswith("WITH ") else sql
        return function

    return register


def java_hash(text: str) -> str:
    """DuckDB SQL of the 32-bit string hash, signed."""
    folded = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)), lambda a, b: (a * 31 + b) & 4294967295)"
    return f"(SELECT CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END FROM (SELECT {folded} AS h))"


def cursor(order: str, offset: str) -> str:
    """DuckDB SQL of a cursor's text."""
    return f"('001-' || lpad(lower(hex({order}::BIGINT)), 4, '0') || '-' || CASE WHEN {offset} < 0 THEN CAST({offset} AS VARCHAR) ELSE lpad(CAST({offset} AS VARCHAR), 18, '0') END)"


#: Common tables: log, per-partition sizes, timelines with their starts, the log on timelines, and a cursor in each full timeline.
BASE = """
WITH hashed AS (SELECT *, CAST(user_id AS VARCHAR) AS key, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST(user_id AS VARCHAR), ''), lambda x: unicode(x)::BIGINT)), lambda a, b: (a * 31 + b) & 4294967295) AS h FROM events),
parted AS (SELECT event_id, ts, user_id, event_type, value, props, key, CAST(abs((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 8) AS INTEGER) AS partition FROM hashed),
log AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS "offset" FROM parted),
sizes AS (SELECT partition, count(*) AS n FROM log GROUP BY partition),
tl AS (SELECT partition, tl_order, CAST(CASE tl_order WHEN 1 THEN n // 4 WHEN 2 THEN 0 WHEN 3 THEN n // 2 - n // 4 ELSE n - n // 2 END AS BIGINT) AS size FROM sizes, (VALUES (1), (2), (3), (4)) AS o(tl_order)),
lines AS (SELECT *, CAST(sum(size) OVER (PARTITION BY partition ORDER BY tl_order) - size AS BIGINT) AS start, size - 1 AS last_offset, tl_order = 4 AS is_open FROM tl),
tlog AS (SELECT g.*, l.tl_order, g."offset" - l.start AS tl_offset FROM log g JOIN lines l ON g.partition = l.partition AND g."offset" >= l.start AND g."offset" < l.start + l.size),
cursors AS (SELECT partition, tl_order AS c_order, (7 * partition + 3 * tl_order) % size AS c_offset FROM lines WHERE size > 0),
commits AS (SELECT partition, (7 * partition * partition) % n AS committed FROM sizes)
"""
