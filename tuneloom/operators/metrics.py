"""Scores over tables of predictions, for any number of groups (`keys`) at once.

Every metric is counts or sums that combine on the map side; rows are shuffled
only as distinct (group, score) counts for the area under the curve.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.functions import scores
from tuneloom.operators import skew

EPS = 1e-15


def accuracy(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def class_counts(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    """Per group and class: rows of the class, rows predicted as it, and both."""
    cells = df.groupBy(*keys, y, pred).agg(F.count("*").alias("_c"))
    sides = F.explode(F.array(
        F.struct(F.col(y).alias("label"), F.col("_c").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col(y) == F.col(pred), F.col("_c")).otherwise(0).alias("hits")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("support"), F.col("_c").alias("predicted"),
                 F.lit(0).cast("long").alias("hits"))))
    return cells.select(*keys, sides.alias("_s")).select(*keys, "_s.*").groupBy(*keys, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))


def _weighted(df, keys, y, pred, value: Column, name: str) -> DataFrame:
    per_class = class_counts(df, keys, y, pred)
    return per_class.groupBy(*keys).agg((F.sum(F.col("support") * value) / F.sum("support")).alias(name))


def weighted_precision(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """0 for a class that is never predicted."""
    value = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    return _weighted(df, keys, y, pred, value, "precision")


def weighted_recall(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    value = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    return _weighted(df, keys, y, pred, value, "recall")


def weighted_f1(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    return _weighted(df, keys, y, pred, 2.0 * F.col("hits") / (F.col("support") + F.col("predicted")), "f1")


def clipped(p: Column, eps: float = EPS) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


def log_loss(df: DataFrame, classes: Sequence, keys: Sequence[str] = (), y: str = "y", probs: str = "probs") -> DataFrame:
    """Mean -ln of the probability of the true class; `probs` follows the order of `classes`."""
    at = [F.get(F.col(probs), F.lit(i)) for i in range(len(classes))]
    total = reduce(lambda a, b: a + b, [clipped(p) for p in at])
    true = F.coalesce(*[F.when(F.col(y) == F.lit(c), clipped(p)) for c, p in zip(classes, at)])
    return df.groupBy(*keys).agg(F.avg(-F.log(true / total)).alias("logloss"))


def roc_auc(df: DataFrame, keys: Sequence[str] = (), positive: Column | None = None, score: str = "p") -> DataFrame:
    """Exact area under the curve with average ranks for equal scores.

    Scores are counted first; the running count of negatives is cut into ranges,
    so neither a frequent score nor a single big group ends in one task.
    """
    pos = F.col("y") == 1 if positive is None else positive
    keys = list(keys)
    base = df if keys else df.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    counts = base.groupBy(*by, score).agg(F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_n"))
    ranked = skew.running(counts, by, [score], {"_below": ("sum_before", F.col("_n"))}, settle=True)
    area = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2.0))
    out = ranked.groupBy(*by).agg(
        (area / (F.sum("_p").cast("double") * F.sum("_n"))).alias("roc_auc"), F.sum("_p").alias("n_pos"))
    return out if keys else out.drop("_all")


def roc_auc_ovr(df: DataFrame, classes: Sequence, keys: Sequence[str] = (), y: str = "y", probs: str = "probs") -> DataFrame:
    """One class against the rest, weighted by the share of the class."""
    each = F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), F.get(F.col(probs), F.lit(i)).alias("p"), (F.col(y) == F.lit(c)).alias("hit"))
        for i, c in enumerate(classes)]))
    long = df.select(*keys, each.alias("_e")).select(*keys, "_e.*")
    per_class = roc_auc(long, [*keys, "label"], F.col("hit"), "p")
    return per_class.groupBy(*keys).agg((F.sum(F.col("roc_auc") * F.col("n_pos")) / F.sum("n_pos")).alias("roc_auc"))


def argmax(probs: str, classes: Sequence) -> Column:
    """Class of the largest probability; the first one on ties."""
    at = [F.get(F.col(probs), F.lit(i)) for i in range(len(classes))]
    best = F.greatest(*at) if len(at) > 1 else at[0]
    return F.coalesce(*[F.when(p == best, F.lit(c)) for c, p in zip(classes, at)])


def loss(df: DataFrame, metric: str, classes: Sequence, keys: Sequence[str] = (), y: str = "y", probs: str = "probs", pred: str | None = None) -> DataFrame:
    """The signed loss (smaller is better) of one of the six metrics per group."""
    if metric not in scores.METRICS:
        raise ValueError(f"unknown metric {metric}")
    if metric == "logloss":
        out = log_loss(df, classes, keys, y, probs)
    elif metric == "roc_auc" and len(classes) == 2:
        flat = df.withColumn("_score", F.get(F.col(probs), F.lit(1)))
        out = roc_auc(flat, keys, F.col(y) == F.lit(classes[1]), "_score")
    elif metric == "roc_auc":
        out = roc_auc_ovr(df, classes, keys, y, probs)
    else:
        named = df.withColumn("_pred", F.col(pred) if pred else argmax(probs, classes))
        fn = {"accuracy": accuracy, "precision": weighted_precision, "recall": weighted_recall, "f1": weighted_f1}[metric]
        out = fn(named, keys, y, "_pred")
    return out.select(*keys, scores.signed_loss(F.col(metric), F.lit(metric)).alias("loss"))
