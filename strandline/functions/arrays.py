"""Expressions on arrays that several operators use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def median_of(values: Column) -> Column:
    """The median of an array of numbers; null of an empty one."""
    return bound(F.sort_array(values), lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)


def field(rows: Column, name: str) -> Column:
    """The array of one field of an array of structs."""
    return F.transform(rows, lambda r: r[name])
