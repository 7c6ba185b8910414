"""Views built on other views.

``parent(t, p, fn)`` is fn's result for (t, p): the stored copy when a
materialization run has written it (so the child reads the table, a consistent
snapshot with a short lineage), else the view computed in place (Catalyst then
plans parent and child as one query).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def stored_key(name: str, p) -> tuple:
    return ("stored_view", name, p)


def parent(t, p, fn: Callable) -> DataFrame:
    stored = t.cache.get(stored_key(fn.__name__, p))
    return stored if stored is not None else fn(t, p)


def stored(t, p, fn) -> DataFrame | None:
    """fn's stored result for (t, p), if a materialization run wrote it."""
    return t.cache.get(stored_key(fn.__name__, p))
