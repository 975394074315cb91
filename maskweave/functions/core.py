"""Helpers for higher-order expressions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once per row."""
    return F.transform(F.array(value), body)[0]


def fold(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(items, start, step)


def sql_string(text: str) -> str:
    """A literal for SQL text that takes backslashes as they are."""
    return "'" + text.replace("'", "''") + "'"


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)
