"""Naming an intermediate column inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
