"""Exact order statistics of columns of any size: distinct values are counted, and running sums of the counts place them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.operators import skew


def values_at(df: DataFrame, cols: Sequence[str], places: Callable[[int], Sequence[int]]) -> dict[str, dict[int, float]]:
    """The values at the given places (from 0, of `places(n)` for n values) in the order of each column, all columns in one pass.

    Null and NaN have no place. Only the asked values reach the driver.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in cols)))
    counts = df.select(each.alias("e")).select("e.*").where("x IS NOT NULL AND NOT isnan(x)").groupBy("name", "x").agg(F.count("*").alias("n"))
    placed = skew.running(counts, ["name"], ["x"], {"before": ("sum_before", F.col("n"))}, settle=True)
    sizes = {r["name"]: r["size"] for r in placed.groupBy("name").agg(F.sum("n").alias("size")).collect()}
    asked = {c: sorted(set(places(n))) for c, n in sizes.items()}
    if not asked:
        return {c: {} for c in cols}
    table = F.create_map(*(x for c, ks in asked.items() for x in (F.lit(c), F.array(*(F.lit(k).cast("long") for k in ks)))))
    hit = F.filter(F.element_at(table, F.col("name")), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
    found: dict[str, dict[int, float]] = {c: {} for c in cols}
    for r in placed.select("name", "x", F.explode(hit).alias("k")).collect():
        found[r["name"]][r["k"]] = r["x"]
    return found


def quantiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of each column, interpolated between neighbouring values; empty for a column without values."""
    def places(n: int) -> list[int]:
        return [k for p in shares for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    sizes: dict[str, int] = {}

    def noted(name: str, at: dict[int, float]) -> list[float]:
        out = []
        for p in shares if at else ():
            place = p * (sizes[name] - 1)
            low, high = at[math.floor(place)], at[math.ceil(place)]
            out.append(low + (high - low) * (place - math.floor(place)))
        return out

    found = values_at(df, cols, lambda n: [*places(n), n - 1])
    sizes.update({c: max(at) + 1 for c, at in found.items() if at})
    return {c: noted(c, found[c]) for c in cols}


def robust_scale(df: DataFrame, cols: Sequence[str], name: Callable[[str], str] = lambda c: f"{c}_r") -> DataFrame:
    """Columns less their median, in units of the distance between the quartiles; a distance of 0 counts as 1."""
    found = quantiles(df, cols, (0.25, 0.5, 0.75))
    return df.withColumns({name(c): (F.col(c) - q[1]) / ((q[2] - q[0]) or 1.0) if q else F.lit(None).cast("double") for c, q in found.items()})


def rank_scale(df: DataFrame, cols: Sequence[str], n: int = 100, name: Callable[[str], str] = lambda c: f"{c}_q") -> DataFrame:
    """Numbers to their quantile in [0, 1] by up to `n` - 1 cut points, the values that close each n-th of the rows; equal ones count once.

    Null and NaN become null. The smallest value goes to 0, the largest to 1, or 0 if no cut point lies between them.
    """
    found = values_at(df, cols, lambda m: [0, m - 1, *(-(-i * m // n) - 1 for i in range(1, n))])
    out = {}
    for c, at in found.items():
        ends = (min(at), max(at)) if at else (0, 0)
        cuts = sorted({at[k] for k in {-(-i * (ends[1] + 1) // n) - 1 for i in range(1, n)}} if at else ())
        low, high = (sum(x <= at[k] for x in cuts) for k in ends) if at else (0, 0)

        def passed(x: Column, cuts: list[float] = cuts) -> Column:
            return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda v: v <= x))

        known = F.col(c).isNotNull() & ~F.isnan(c)
        out[name(c)] = F.when(known, (passed(F.col(c)) - low) / float(max(1, high - low)))
    return df.withColumns(out)
