"""Bind a computed column to a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Without this, a column used n times inside another is copied n times into the
    plan, and nested helpers grow the plan exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
