"""Building blocks of expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, however often that names it.

    A lambda variable can't be inlined, so Catalyst cannot copy ``value`` into a loop.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """The value of ``key`` in a small constant table; null or ``default`` where it isn't there."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, default)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def empty_if_null(values: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(values, F.array().cast(kind))


def no_strings() -> Column:
    return F.array().cast("array<string>")
