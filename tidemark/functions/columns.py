"""Expressions that follow panel conventions: missing is NULL, ratios of nothing are NULL, ties are fixed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(column: Column) -> Column:
    """A double; what cannot be read as a number, and NaN, becomes NULL."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def missing_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NaN to NULL once, at ingest; later comparisons and aggregates then skip missing cells."""
    return df.withColumns({c: number(F.col(c)) for c in columns})


def history(back: int, upto: int = 0):
    """Rows from ``back`` before to ``upto`` before the current one, within a symbol, by date."""
    return Window.partitionBy("symbol").orderBy("date").rowsBetween(-back, -upto)


def by_date():
    return Window.partitionBy("symbol").orderBy("date")


def enough(value: Column, x: str, window, least: int) -> Column:
    """``value`` over a window that holds at least ``least`` known cells of ``x``, else NULL."""
    return F.when(F.count(x).over(window) >= least, value)
