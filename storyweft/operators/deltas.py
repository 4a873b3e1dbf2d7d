"""Stored counts kept by signed changes: what is added up is folded, a least or greatest value is read again only where it went.

A view has a row a key: n rows, sums, least and greatest values. Changes are rows with a sign, 1 for one that came, -1 for one
that went; an update is both. Keys whose n falls to 0 leave the view.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def view_of(rows: DataFrame, keys: list[str], sums: list[str] = (), least: list[str] = (), greatest: list[str] = ()) -> DataFrame:
    """keys, n, sum_c, min_c, max_c of rows."""
    aggregates = [F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in sums), *(F.min(c).alias(f"min_{c}") for c in least), *(F.max(c).alias(f"max_{c}") for c in greatest)]
    return rows.groupBy(*keys).agg(*aggregates)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def folded(view: DataFrame, changes: DataFrame, rows: DataFrame, keys: list[str], sums: list[str] = (), least: list[str] = (), greatest: list[str] = ()) -> DataFrame:
    """The view after changes (columns of rows, and sign); rows is the table after them, of which only keys are read that
    lost a row at one of their ends. Null is a key as any other."""
    ends = [*((f"min_{c}", c, F.min) for c in least), *((f"max_{c}", c, F.max) for c in greatest)]
    came, went = F.col("sign") > 0, F.col("sign") < 0
    delta = changes.groupBy(*keys).agg(
        F.sum("sign").alias("d_n"), *(F.coalesce(F.sum(F.col(c) * F.col("sign")), F.lit(0)).alias(f"d_sum_{c}") for c in sums),
        *(f(F.when(came, F.col(c))).alias(f"in_{name}") for name, c, f in ends), *(f(F.when(went, F.col(c))).alias(f"out_{name}") for name, c, f in ends),
    )
    old, new = view.alias("o"), delta.alias("d")
    met = old.join(new, _same(view, delta, keys), "full")
    key = [F.when(F.col("o.n").isNotNull(), F.col(f"o.{k}")).otherwise(F.col(f"d.{k}")).alias(k) for k in keys]
    zero = lambda c: F.coalesce(c, F.lit(0))
    lost = reduce(lambda x, y: x | y, (F.coalesce(F.col(f"out_{name}") <= F.col(name) if name.startswith("min_") else F.col(f"out_{name}") >= F.col(name), F.lit(False)) for name, _, _ in ends), F.lit(False))
    grown = [(F.least if name.startswith("min_") else F.greatest)(F.col(name), F.col(f"in_{name}")).alias(name) for name, _, _ in ends]
    sum_ = [(zero(F.col(f"o.sum_{c}")) + zero(F.col(f"d_sum_{c}"))).alias(f"sum_{c}") for c in sums]
    out = met.select(*key, (zero(F.col("o.n")) + zero(F.col("d_n"))).alias("n"), *sum_, *grown, lost.alias("lost")).filter("n > 0")
    if not ends:
        return out.drop("lost")
    stale = out.filter("lost").select(*keys)
    again = rows.join(stale, _same(rows, stale, keys), "left_semi").groupBy(*keys).agg(*(f(c).alias(f"re_{name}") for name, c, f in ends))
    both = out.join(again, _same(out, again, keys), "left")
    return both.select(*[out[k] for k in keys], "n", *[f"sum_{c}" for c in sums], *[F.when(F.col("lost"), F.col(f"re_{name}")).otherwise(F.col(name)).alias(name) for name, _, _ in ends])
