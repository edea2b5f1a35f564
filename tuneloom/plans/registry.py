"""Registered queries: a Spark callable and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from tuneloom.plans.view_sql import VIEW_SQL


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def _used(text: str) -> list[str]:
    return [v for v in VIEW_SQL if re.search(rf"\b{v}\b", text)]


def with_views(body: str) -> str:
    """Prefixes the view definitions the text uses; the text may go on with its own WITH items."""
    needed: set[str] = set()
    todo = _used(body)
    while todo:
        v = todo.pop()
        if v not in needed:
            needed.add(v)
            todo.extend(u for u in _used(VIEW_SQL[v]) if u != v)
    ctes = [f"{v} AS ({VIEW_SQL[v].strip()})" for v in VIEW_SQL if v in needed]
    text = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(head):
            return head + ",\n".join([*ctes, text[len(head):]])
    return ("WITH " + ",\n".join(ctes) + "\n" + text) if ctes else text


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(name, fn, with_views(sql) if sql else None)
        return fn
    return register
