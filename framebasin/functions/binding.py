"""Binding of intermediate values inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it.

    Plain columns are substituted into predicates that Spark pushes down; a bound
    value stays one evaluation there too.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
