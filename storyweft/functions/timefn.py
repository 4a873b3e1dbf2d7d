"""Time: consistency steps, windows, day bounds, lenient parsing, relative labels. No function reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in turn once a leading weekday is gone.
FORMATS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 3_600_000_000


def date_consistency(a: Column, b: Column) -> Column:
    """0.5 if either is unknown; 1 up to 48 hours, 0.6 up to 168, else 0."""
    h = hours_between(a, b)
    return F.when(a.isNull() | b.isNull(), 0.5).when(h <= 48, 1.0).when(h <= 168, 0.6).otherwise(0.0)


def within_days(a: Column, b: Column, days: int) -> Column:
    """False if either is unknown."""
    return F.coalesce(hours_between(a, b) <= 24 * days, F.lit(False))


def in_window(x: Column, start: str | None, until: str | None) -> Column:
    """start <= x < until; an open side is no condition."""
    ok = F.lit(True)
    if start is not None:
        ok &= x >= F.lit(start).cast("timestamp")
    if until is not None:
        ok &= x < F.lit(until).cast("timestamp")
    return ok


def in_days(x: Column, first: str, last: str) -> Column:
    """From the start of the first day to the end of the last (UTC)."""
    return (x >= F.lit(first).cast("timestamp")) & (x < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))


def local_day(x: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(x, zone), "yyyy-MM-dd")


def parse_any(x: Column) -> Column:
    """Mail, ISO and plain dates; a text without zone is UTC; null if nothing fits."""
    bare = F.regexp_replace(F.trim(x), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS])


def relative_day(day: Column, today: Column) -> Column:
    """today, yesterday, tomorrow, then days, weeks, months or years ago or ahead."""
    d = F.datediff(today, day)
    n = F.abs(d)
    unit = lambda k, name: F.concat(F.floor(n / k).cast("string"), F.when(F.floor(n / k) == 1, F.lit(f" {name}")).otherwise(F.lit(f" {name}s")))
    span = F.when(n < 7, unit(1, "day")).when(n < 30, unit(7, "week")).when(n < 365, unit(30, "month")).otherwise(unit(365, "year"))
    side = F.when(d > 0, F.concat(span, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), span))
    return F.when(d == 0, "today").when(d == 1, "yesterday").when(d == -1, "tomorrow").otherwise(side)
