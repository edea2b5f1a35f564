"""Signs, worst scores and clean-up of scores. Losses are signed so that smaller is better."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six metrics, and the losses a failed run gets.
METRICS = ("accuracy", "precision", "recall", "f1", "logloss", "roc_auc")
WORST_LOGLOSS = 100.0
WORST_OTHER = 0.0
WORST_STRUCTURE = 0.0
MISSING_AUC = 0.0
MISSING_LOGLOSS = 4.0


def signed_loss(score: Column, metric: Column) -> Column:
    return F.when(metric == "logloss", score).otherwise(-score)


def worst_loss(metric: Column) -> Column:
    return F.when(metric == "logloss", F.lit(WORST_LOGLOSS)).otherwise(F.lit(WORST_OTHER))


def worst_loss_of(metric: str) -> float:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return WORST_LOGLOSS if metric == "logloss" else WORST_OTHER


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def loss_or_worst(loss: Column, metric: Column, ok: Column | None = None) -> Column:
    """The loss of a run, or the worst loss of its metric when the run failed or is not finite."""
    good = finite(loss) if ok is None else finite(loss) & ok
    return F.when(good, loss).otherwise(worst_loss(metric))


def impute_missing(result: Column, metric: Column) -> Column:
    """NULL or NaN becomes 0 for auc and 4 for logloss; any other metric is an error."""
    fill = (
        F.when(metric == "auc", F.lit(MISSING_AUC))
        .when(metric == "logloss", F.lit(MISSING_LOGLOSS))
        .otherwise(F.raise_error(F.concat(F.lit("unknown metric "), metric)).cast("double"))
    )
    return F.when(result.isNull() | F.isnan(result), fill).otherwise(result)


def clip_scores(score: Column, first: Column, second: Column, factor: Column) -> Column:
    """Clamped between two bounds in any order, then scaled."""
    return F.greatest(F.least(first, second), F.least(F.greatest(first, second), score)) * factor


def elapsed_seconds(ts_micros: Column, start_micros: Column) -> Column:
    return (ts_micros - start_micros) / 1e6
