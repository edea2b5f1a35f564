"""Labelled tables, stored datasets, benchmark sheets and trajectories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET_SCHEMA = "task STRING, fold INT, metric STRING, result DOUBLE"
MIN_TIME = 0
MAX_TIME = 3660  # fixed value: the comparison horizon in seconds


def read_labelled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; the last column is the target and becomes `label`."""
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
    return df.withColumnRenamed(df.columns[-1], "label")


def fold_split(rows: DataFrame, folds: DataFrame, fold: int, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(train, test) of a stored fold table (key, fold)."""
    held = folds.where(F.col("fold") == fold).select(key)
    return rows.join(held, key, "left_anti"), rows.join(held, key, "left_semi")


def store_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_benchmark(results: DataFrame, path: str) -> None:
    """One result sheet per system, in a folder named after it."""
    results.select("task", "fold", "metric", "result", "system").write.partitionBy("system").csv(path, header=True)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """The result sheets of all systems as one table."""
    return spark.read.csv(path, schema=f"{SHEET_SCHEMA}, system STRING", header=True)


def union_systems(parts: dict[str, DataFrame]) -> DataFrame:
    named = [df.withColumn("system", F.lit(s)) for s, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def complete_trajectories(points: DataFrame, expected: DataFrame, keys: list[str], worst: Column) -> DataFrame:
    """Points of every expected trajectory; a missing one gets two points with the worst score."""
    missing = expected.join(points.select(*keys).distinct(), keys, "left_anti")
    ends = F.explode(F.array(F.lit(MIN_TIME).cast("long"), F.lit(MAX_TIME).cast("long"))).alias("sec")
    default = missing.select(*keys, ends, worst.alias("score"))
    found = points.join(expected, keys, "left_semi").select(*keys, "sec", "score")
    return found.unionByName(default)
