"""Pages of catalogs: offset and keyset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def offset_page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page by offset. ``limit`` is 1 to 1000."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit is 1 to 1000, offset at least 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_links(rows: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, dict]:
    """A page and the offsets of its neighbours: one more row than asked for tells whether there is a next page."""
    ahead = rows.orderBy(*order).offset(offset).limit(limit + 1)
    more = ahead.count() > limit
    return rows.orderBy(*order).offset(offset).limit(limit), {"prev": max(0, offset - limit) if offset else None, "next": offset + limit if more else None}


#: What a token's letter asks of the id: condition and direction.
_TOKENS = {"F": (">", True), "W": (">=", True), "B": ("<", False), "I": ("<=", False)}


def keyset_page(rows: DataFrame, key: str, token: str | None, limit: int) -> DataFrame:
    """A page by keyset: the ``limit`` rows next to the token's id, in ascending order."""
    if not token:
        return rows.orderBy(key).limit(limit)
    if token[0] not in _TOKENS:
        raise ValueError(f"not a token: {token}")
    sign, forward = _TOKENS[token[0]]
    side = rows.where(F.expr(f"`{key}` {sign} '{token[1:]}'"))
    return side.orderBy(F.col(key) if forward else F.desc(key)).limit(limit).orderBy(key)


def containing_all(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose array holds all of ``values``."""
    for v in values:
        rows = rows.where(F.array_contains(column, v))
    return rows
