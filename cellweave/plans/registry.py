"""Named queries and the SQL text each one is compared with."""

from __future__ import annotations

import re

from cellweave.plans import fixtures

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``sql`` may name any ``fx_`` view of the fixtures."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return deco


def compose(body: str) -> str:
    """Put the used fixture views in front of a body that is a SELECT or ``cte AS (...), ... SELECT``."""
    body = body.strip()
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in re.findall(r"\bfx_\w+", text):
            if view not in needed and view in fixtures.SQL:
                visit(fixtures.SQL[view])
                needed.append(view)

    visit(body)
    views = [f"{v} AS ({fixtures.SQL[v]})" for v in needed]
    if body[:6].upper() == "SELECT":
        return ("WITH RECURSIVE " + ",\n".join(views) + "\n" if views else "") + body
    return "WITH RECURSIVE " + ",\n".join([*views, body])
