"""Seeded splits. The place of a row depends on its key alone, so it holds under any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.functions import draws
from tuneloom.operators import skew


def holdout_split(rows: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Marks about `share` of the rows as `is_test`, not stratified."""
    return rows.withColumn("is_test", draws.uniform(seed, key) < share)


def _order_in_label(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return skew.row_numbers(rows.withColumn("_digest", digest), [label], ["_digest", key], "_rn").drop("_digest")


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Marks `share` of each class as `is_test`, in a random order of the class."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    placed = _order_in_label(rows, label, key, seed)
    joined = skew.salted_join(placed, sizes, [label])
    return joined.withColumn("is_test", F.col("_rn") < F.round(F.col("_n") * share)).drop("_rn", "_n")


def stratified_folds(rows: DataFrame, label: str, key: str, k: int = 4, seed: int = 42) -> DataFrame:
    """Adds `fold` 0..k-1, every class spread evenly."""
    placed = _order_in_label(rows, label, key, seed)
    return placed.withColumn("fold", (F.col("_rn") % k).cast("int")).drop("_rn")


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
