"""Calendar-day expressions. Every history frame comes from ``before_day``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def day_number(date: str | Column) -> Column:
    """Days since the epoch, the ordering key of all history windows."""
    return F.unix_date(date)


def before_day(*keys: str, day: str = "day") -> WindowSpec:
    """All earlier days of the key and never the day itself (``date < D``).

    Use it on rows already aggregated per key and day: a window partition then
    has at most one row per calendar day, however busy the key is.
    """
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)


def first_and_last_date(txn: DataFrame, column: str = "txn_date") -> tuple[dt.date, dt.date]:
    """First and last date of the dataset (one row to the driver)."""
    row = txn.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if row is None or row["a"] is None:
        raise ValueError("no transactions")
    return row["a"], row["b"]


def clean_round(value: str | Column, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero, for comparison between engines."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c, digits) + F.lit(0.0)
