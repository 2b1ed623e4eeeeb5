"""Registered queries: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from soundalike.sources import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_VIEWS = {name[:-4].lower(): text for name, text in vars(views).items()
          if name.endswith("_SQL")}


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs of the domain views it names."""
    used = [text for name, text in _VIEWS.items() if re.search(rf"\b{name}\b", body)]
    body = body.strip()
    recursive = body[:15].upper() == "WITH RECURSIVE "
    if recursive:
        body = "WITH " + body[15:]
    if used:
        body = "WITH " + ", ".join(used) + (
            ", " + body[5:] if body[:5].upper() == "WITH " else " " + body)
    return body.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return add
