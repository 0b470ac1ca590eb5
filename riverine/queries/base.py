"""Registry of the drainage queries, each with its SQL for checking where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..sources.fixtures import SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **extra: str):
    """Registers fn(spark, sf_dir) under its name; views fx_* that the SQL mentions become its common table expressions.

    extra: further common table expressions, in order, before the SQL.
    """

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            whole = " ".join([*extra.values(), sql])
            used = {k: v for k, v in SQL.items() if re.search(rf"\b{k}\b", whole)} | extra
            recursive = "RECURSIVE " if any("UNION" in v for v in extra.values()) else ""
            head = f"WITH {recursive}" + ",\n".join(f"{k if '(' in k else k} AS ({v})" for k, v in used.items()) + "\n" if used else ""
            ORACLES[fn.__name__] = head + sql
        return fn

    return add
