"""Comparison of systems over tasks: statistics, ranks and the paired signed-rank test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.functions import normal
from tuneloom.functions.scores import MISSING_AUC, MISSING_LOGLOSS
from tuneloom.operators import skew

ALPHA = 0.05


def task_statistics(results: DataFrame) -> DataFrame:
    """Mean, sample deviation, metric and number of missing results per (task, system), in one pass."""
    missing = F.col("result").isin(MISSING_AUC, MISSING_LOGLOSS)
    return results.groupBy("task", "system").agg(
        F.avg("result").alias("mean"), F.coalesce(F.stddev_samp("result"), F.lit(0.0)).alias("std"),
        F.max("metric").alias("metric"), F.count_if(missing).alias("missing"))


def _signed(value: str) -> Column:
    """Larger is better for auc, smaller for logloss."""
    return F.when(F.col("metric") == "auc", -F.col(value)).otherwise(F.col(value))


def rank_average(results: DataFrame, keys: Sequence[str], value: str = "result") -> DataFrame:
    """Rank of each system inside `keys` with ties averaged; the best rank is 1."""
    signed = results.withColumn("_signed", _signed(value))
    return skew.average_ranks(signed, list(keys), "_signed", "rank").drop("_signed")


def average_rank(stats: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Mean over the tasks of a metric of each system's rank by its mean result."""
    used = stats.where(~F.col("task").isin(*exclude)) if exclude else stats
    ranked = rank_average(used, ["metric", "task"], "mean")
    return ranked.groupBy("metric", "system").agg(F.avg("rank").alias("avg_rank"), F.count("*").alias("n_tasks"))


def best_system(stats: DataFrame) -> DataFrame:
    """System with the best mean per task; the first name on ties."""
    key = F.struct(_signed("mean"), F.col("system"))
    return stats.groupBy("task", "metric").agg(
        F.min_by("system", key).alias("best_system"), F.min_by("mean", key).alias("best_mean"))


def paired_results(results: DataFrame, best: DataFrame) -> DataFrame:
    """Each system's result next to the best system's, per (task, fold); a fold has one row per system."""
    marked = results.join(best.select("task", "best_system"), "task")
    is_best = F.col("system") == F.col("best_system")
    ref = F.max(F.when(is_best, F.col("result"))).over(Window.partitionBy("task", "fold"))
    paired = marked.withColumn("ref", ref).where(~is_best & F.col("ref").isNotNull())
    return paired.select("task", "system", "fold", "ref", "result")


def exact_lower_tail(n: Column, w: Column) -> Column:
    """P(W <= w) of the signed-rank statistic of n pairs without ties.

    The chances of the sums 0..w, one rank after the other: half of the time a rank counts, half of the time not.
    """
    start = F.transform(F.sequence(F.lit(0), w.cast("int")), lambda k: F.when(k == 0, 1.0).otherwise(0.0))

    def with_rank(chances: Column, rank: Column) -> Column:
        return F.transform(chances, lambda x, k: (x + F.when(k >= rank, F.get(chances, k - rank)).otherwise(0.0)) / 2)

    chances = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, with_rank)
    return F.aggregate(chances, F.lit(0.0), lambda total, x: total + x)


def wilcoxon(pairs: DataFrame, method: str, digits: int = 9) -> DataFrame:
    """Two-sided signed-rank test per (task, system) on pairs (ref, result).

    Zero differences are dropped. `method` is "exact" or "normal" for any number of pairs; where zeros
    or ties leave no exact null distribution, "exact" too is normal with tie correction.
    """
    if method not in ("exact", "normal"):
        raise ValueError(f"unknown method {method}")
    keys = ["task", "system"]
    d = F.round(F.col("ref") - F.col("result"), digits)
    by_size = pairs.select(*keys, d.alias("d")).groupBy(*keys, F.abs("d").alias("a")).agg(
        F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("pos"), F.count_if(F.col("d") < 0).alias("neg"))
    placed = skew.running(by_size, keys, ["a"], {"before": ("sum_before", F.col("t"))}, settle=True)
    # ranks counted with the zero differences, which all come first and are taken off below
    rank, real = F.col("before") + (F.col("t") + 1) / 2, F.col("a") > 0
    cube = F.col("t") * F.col("t") * F.col("t") - F.col("t")
    sums = placed.groupBy(*keys).agg(
        F.sum("t").alias("n_pairs"), F.sum(F.when(real, F.col("t")).otherwise(0)).alias("n"),
        F.sum(rank * F.col("pos")).alias("up"), F.sum("pos").alias("n_up"),
        F.sum(rank * F.col("neg")).alias("down"), F.sum("neg").alias("n_down"),
        F.sum(F.when(real, cube).otherwise(0)).alias("ties"))
    zeros = F.col("n_pairs") - F.col("n")
    joined = sums.select(
        *keys, "n", "n_pairs", "ties", (F.col("up") - zeros * F.col("n_up")).alias("w_plus"),
        (F.col("down") - zeros * F.col("n_down")).alias("w_minus"))

    n, w = F.col("n"), F.least("w_plus", "w_minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    z = (w - n * (n + 1) / 4.0) / spread
    p_normal = F.least(F.lit(1.0), 2.0 * normal.upper_tail(F.abs(z)))
    p = p_normal
    if method == "exact":
        exact = (n == F.col("n_pairs")) & (F.col("ties") == 0) & (n > 0)
        tail = exact_lower_tail(F.when(exact, n).otherwise(1), F.when(exact, w).otherwise(0.0))
        p = F.when(exact, F.least(F.lit(1.0), 2.0 * tail)).otherwise(p_normal)
    p = F.when(n > 0, p)
    return joined.select(
        *keys, "n", w.alias("statistic"), p.alias("p_value"), F.coalesce(p < ALPHA, F.lit(False)).alias("significant"))


def comparison_cells(results: DataFrame, method: str, exclude: Sequence[str] = ()) -> DataFrame:
    """One row per (task, system): mean, deviation and a flag.

    Flags: missing (mean is 0 or 4), best, same (not significantly worse), worse.
    """
    stats = task_statistics(results)
    if exclude:
        stats = stats.where(~F.col("task").isin(*exclude))
    best = best_system(stats)
    test = wilcoxon(paired_results(results, best), method).select("task", "system", "significant")
    # tasks x systems rows; AQE turns the joins into broadcasts when they are small
    joined = stats.join(best.select("task", "best_mean"), "task").join(test, ["task", "system"], "left")
    flag = (
        F.when(F.col("mean").isin(MISSING_AUC, MISSING_LOGLOSS), "missing")
        .when(F.col("mean") == F.col("best_mean"), "best")
        .when(~F.coalesce("significant", F.lit(False)), "same").otherwise("worse"))
    return joined.select("task", "metric", "system", "mean", "std", flag.alias("flag"))


def comparison_table(cells: DataFrame) -> DataFrame:
    """Task x system: mean, deviation and flag of every system that occurs, as columns named after it."""
    return cells.groupBy("task", "metric").pivot("system").agg(F.max("mean").alias("mean"), F.max("std").alias("std"), F.max("flag").alias("flag"))


def rank_per(results: DataFrame, part: str, value: str, name: str = "rank") -> DataFrame:
    """Average rank inside small parts (one row per system)."""
    ties = Window.partitionBy(part, value)
    order = Window.partitionBy(part).orderBy(value)
    return results.withColumn(name, F.rank().over(order) + (F.count("*").over(ties) - 1) / 2)
