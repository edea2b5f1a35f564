"""Scores over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.operators import compare, skew


def asof_raster(points: DataFrame, step: int, horizon, worst: float = 0.0) -> DataFrame:
    """Score of every system at each tick: the latest point strictly before it, else the worst score.

    Ticks and points are put in one order per system; a tick stands before a
    point of the same second. A system with very many points is cut into ranges.
    """
    long = F.lit(0).cast("long")
    grid = points.select("system").distinct().select(
        "system", F.explode(F.sequence(long, horizon, F.lit(step).cast("long"))).alias("sec"),
        F.lit(0).alias("kind"), F.lit(None).cast("double").alias("score"))
    both = grid.unionByName(points.select("system", "sec", F.lit(1).alias("kind"), "score"))
    seen = skew.running(both, ["system"], ["sec", "kind"], {"at": ("last", F.col("score"))})
    return seen.where("kind = 0").select("system", "sec", F.coalesce("at", F.lit(worst)).alias("score"))


def rank_over_time(raster: DataFrame) -> DataFrame:
    return compare.rank_per(raster, "sec", "score")


def best_so_far(points: DataFrame) -> DataFrame:
    return skew.running(points, ["system"], ["sec"], {"best": ("max", F.col("score"))})
