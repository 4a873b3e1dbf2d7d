"""Bounds and choices of query arguments."""

from __future__ import annotations

from pyspark.sql import Column

from storyweft.functions import timefn

#: Page, page size and day limits with their defaults.
PAGE = (1, 1_000_000, 1)
SIZE = (1, 200, 25)
DAYS = (1, 180, 30)


def bounded(value: int | str | None, limits: tuple[int, int, int]) -> int:
    """The argument, its default if absent; raises outside its bounds or if it is no whole number."""
    low, high, default = limits
    if value is None or value == "":
        return default
    n = int(value)
    if not low <= n <= high:
        raise ValueError(f"{n} is not between {low} and {high}")
    return n


def time_filter(x: Column, day: str | None = None, first: str | None = None, last: str | None = None, text: str | None = None) -> Column | None:
    """Condition of a feed's time filter: a range wins over a day, a search text turns the day off; None for no filter."""
    if first or last:
        return timefn.in_days(x, first or last, last or first)
    if day and not (text and text.strip()):
        return timefn.in_days(x, day, day)
    return None


def same(column: Column, value: str | None) -> Column | None:
    """Equality where the argument is set."""
    return column == value if value else None


def where(df, *conditions: Column | None):
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df
