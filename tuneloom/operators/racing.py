"""Racing: Hyperband brackets, halving and resampling of candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGE = ["iteration", "rung"]


def n_rungs(eta: float, min_budget: float, max_budget: float) -> int:
    return -int(math.log(min_budget / max_budget) / math.log(eta)) + 1


def hyperband_schedule(iterations: DataFrame, eta: float = 3, min_budget: float = 1, max_budget: float = 27) -> DataFrame:
    """Candidates and budget of every rung of each iteration's bracket."""
    rungs = n_rungs(eta, min_budget, max_budget)
    s = F.lit(rungs - 1) - F.col("iteration") % rungs
    first = F.floor(F.floor(F.lit(float(rungs)) / (F.col("s") + 1)) * F.pow(F.lit(float(eta)), F.col("s")))
    stages = iterations.select("iteration", s.alias("s")).select(
        "iteration", "s", F.explode(F.sequence(F.lit(0), F.col("s"))).alias("rung"))
    n = F.greatest(F.floor(first * F.pow(F.lit(float(eta)), -F.col("rung"))), F.lit(1))
    return stages.select(
        "iteration", F.col("rung").cast("int").alias("rung"), n.cast("int").alias("n_candidates"),
        (float(max_budget) * F.pow(F.lit(float(eta)), -(F.col("s") - F.col("rung")))).alias("budget"),
        (F.col("rung") == F.col("s")).alias("last_rung"))


def most_candidates(eta: float, min_budget: float, max_budget: float) -> int:
    """The largest rung of any bracket; bounds how many candidates can advance at once."""
    rungs = n_rungs(eta, min_budget, max_budget)
    return max(int(math.floor(rungs / (s + 1)) * eta ** s) for s in range(rungs))


def _advance(candidates: DataFrame, schedule: DataFrame, k_max: int, bound: Column) -> DataFrame:
    """Marks the candidates whose 0-based rank by (loss, structure) is below the bound of the next rung.

    Only the best `k_max` per rung can qualify, so the ranking keeps k_max rows per
    task before its shuffle; the marks are joined back to all candidates.
    """
    order = Window.partitionBy(*STAGE).orderBy("loss", "structure")
    top = candidates.select(*STAGE, "structure", "loss", F.row_number().over(order).alias("_rn")).where(F.col("_rn") <= k_max)
    following = schedule.select("iteration", (F.col("rung") - 1).alias("rung"), F.col("n_candidates").alias("k"))
    chosen = top.join(following, STAGE).where(F.col("_rn") - 1 < bound).select(
        *STAGE, "structure", F.lit(True).alias("advance"))
    return candidates.join(chosen, [*STAGE, "structure"], "left").fillna(False, subset=["advance"])


def successive_halving(candidates: DataFrame, schedule: DataFrame, k_max: int) -> DataFrame:
    return _advance(candidates, schedule, k_max, F.col("k"))


def successive_resampling(candidates: DataFrame, schedule: DataFrame, k_max: int,
                          rate: float = 0.5, min_samples: float = 1.0) -> DataFrame:
    bound = F.greatest(F.lit(min_samples), F.col("k") * (1 - rate))
    return _advance(candidates, schedule, max(k_max, math.ceil(min_samples)), bound)


def iteration_progress(candidates: DataFrame, schedule: DataFrame) -> DataFrame:
    """Candidates and running configs per rung; a rung is complete when it is full and nothing is open.

    Candidates of one rung with different budgets are an error.
    """
    running = F.sum(F.when(F.col("status") == "RUNNING", F.floor("budget")).otherwise(0))
    rungs = candidates.groupBy(*STAGE).agg(
        F.count("*").alias("n"), running.alias("n_running"),
        F.count_if(F.col("status").isin("RUNNING", "QUEUED")).alias("n_open"),
        F.min("budget").alias("_lo"), F.max("budget").alias("_hi"))
    joined = rungs.join(schedule, STAGE)
    mixed = F.raise_error(F.lit("not all candidates of a rung have the same budget")).cast("boolean")
    full = F.col("n") >= F.col("n_candidates")
    complete = F.when(F.col("_lo") != F.col("_hi"), mixed).otherwise(full & (F.col("n_open") == 0))
    return joined.select(*STAGE, "n", "n_running", "n_candidates", complete.alias("complete"))


def race_round(candidates: DataFrame, schedule: DataFrame, k_max: int) -> DataFrame:
    """The next version of the candidate table after one racing round.

    In a complete rung the best candidates are QUEUED for the next budget, the
    others TERMINATED; the last rung is COMPLETED. Other rungs stay as they are.
    """
    complete = iteration_progress(candidates, schedule).where("complete").select(*STAGE, F.lit(True).alias("_done"))
    now = schedule.select(*STAGE, "last_rung")
    after = schedule.select("iteration", (F.col("rung") - 1).alias("rung"), F.col("budget").alias("_next_budget"))
    marked = successive_halving(candidates.where("status = 'REVIEW'"), schedule, k_max).select(*STAGE, "structure", "advance")
    joined = (
        candidates.join(complete, STAGE, "left").join(now, STAGE, "left").join(after, STAGE, "left")
        .join(marked, [*STAGE, "structure"], "left"))
    done = F.coalesce("_done", F.lit(False))
    review = F.col("status") == "REVIEW"
    moved = done & review & ~F.coalesce("last_rung", F.lit(False)) & F.coalesce("advance", F.lit(False))
    status = (
        F.when(done & F.coalesce("last_rung", F.lit(False)), "COMPLETED")
        .when(moved, "QUEUED").when(done & review, "TERMINATED").otherwise(F.col("status")))
    return joined.select(
        "iteration", "structure", "loss", status.alias("status"),
        F.when(moved, F.col("rung") + 1).otherwise(F.col("rung")).alias("rung"),
        F.when(moved, F.col("_next_budget")).otherwise(F.col("budget")).alias("budget"))


def constant_budget(structures: DataFrame, budget: int = 5) -> DataFrame:
    """No racing: every structure gets the same number of configurations."""
    return structures.select(
        "iteration", "structure", F.explode(F.sequence(F.lit(1), F.lit(budget))).alias("config_no"))
