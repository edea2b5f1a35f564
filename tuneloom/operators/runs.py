"""Run history: structures, results, incumbents and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.functions import draws
from tuneloom.operators import skew

KEY = ["iteration", "structure"]
RESULT = ["config", "loss", "structure_loss", "status", "origin"]


def structure_results(structures: DataFrame, results: DataFrame) -> DataFrame:
    """Results with their structure. A structure is one row; AQE splits a structure with many results."""
    return results.join(structures, KEY, "inner")


def orphan_results(structures: DataFrame, results: DataFrame) -> DataFrame:
    return results.join(structures.select(*KEY), KEY, "left_anti")


def split_results(structures: DataFrame, results: DataFrame, strict: bool = False) -> DataFrame:
    """All results with `accepted`; with `strict`, an unknown structure is an error."""
    known = structures.select(*KEY).distinct().withColumn("_known", F.lit(True))
    marked = results.join(known, KEY, "left").withColumn("accepted", F.coalesce("_known", F.lit(False))).drop("_known")
    if strict:
        text = F.concat(F.lit("unknown structure "), F.col("structure").cast("string"))
        fail = F.raise_error(text).cast("boolean")
        marked = marked.withColumn("accepted", F.when(F.col("accepted"), True).otherwise(fail))
    return marked


def new_structures(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Structures of `incoming` that are not stored yet, each once."""
    return incoming.dropDuplicates(KEY).join(stored.select(*KEY), KEY, "left_anti")


def successful_runs(structures: DataFrame, results: DataFrame) -> DataFrame:
    return structure_results(structures, results.where(F.col("status") == "SUCCESS"))


def incumbent_per_structure(results: DataFrame) -> DataFrame:
    """Result with the smallest loss; the earliest config on ties."""
    best = F.min_by(F.struct(*RESULT), F.struct("loss", "config"))
    return results.groupBy(*KEY).agg(best.alias("_b")).select(*KEY, *[F.col(f"_b.{c}").alias(c) for c in RESULT])


def incumbent(results: DataFrame) -> DataFrame:
    """Smallest (loss, candidate id) of all results."""
    best = F.min(F.struct("loss", "iteration", "structure", "config"))
    return results.agg(best.alias("b")).select("b.iteration", "b.structure", "b.config", "b.loss")


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_distinct("iteration", "structure").alias("n_structures"),
        F.count("*").alias("n_configs"),
        F.min("loss").alias("incumbent"),
        F.unix_micros(F.max("ts")).alias("end_us"),
    )


def reindex_runs(results: DataFrame) -> DataFrame:
    """Every run with its position inside the structure, in log order."""
    return skew.row_numbers(results, ["structure"], ["ts", "config"], "position")


def candidate_numbering(results: DataFrame) -> DataFrame:
    """Structures numbered per iteration in the order they were first logged."""
    first = results.groupBy(*KEY).agg(F.min("ts").alias("first_ts"))
    return skew.row_numbers(first, ["iteration"], ["first_ts", "structure"], "number")


def candidate_states(structures: DataFrame, results: DataFrame) -> DataFrame:
    """Structures with incumbent loss and a status taken from the latest result."""
    last = F.max_by("status", F.struct("ts", "config"))
    status = F.when(last == "SUCCESS", "REVIEW").when(last == "TIMEOUT", "RUNNING").otherwise("QUEUED")
    state = results.groupBy(*KEY).agg(F.min("loss").alias("loss"), status.alias("status"))
    return structures.join(state, KEY)


def open_candidates(candidates: DataFrame, statuses: Sequence[str] = ("QUEUED", "REVIEW")) -> DataFrame:
    return candidates.where(F.col("status").isin(*statuses))


def usable_results(results: DataFrame, key: Column, vector: Column, size: int) -> DataFrame:
    """Results a density model may learn from: loss and key present, vector of the expected size."""
    return results.where(F.col("loss").isNotNull() & key.isNotNull() & (F.size(vector) == size) & (size > 0))


def explanation_join(steps: DataFrame, explanations: DataFrame) -> DataFrame:
    """Mean explanation loss per run; only runs where every step has an explanation."""
    marked = explanations.select("run_id", "step_no", "loss").withColumn("_has", F.lit(1))
    joined = steps.select("run_id", "step_no").join(marked, ["run_id", "step_no"], "left")
    per_run = joined.groupBy("run_id").agg(
        F.count("*").alias("n_steps"), F.count("_has").alias("n_explained"), F.avg("loss").alias("mean_loss"))
    kept = per_run.where(F.col("n_steps") == F.col("n_explained"))
    return kept.select("run_id", "n_steps", F.greatest(F.lit(-100.0), F.least(F.lit(100.0), "mean_loss")).alias("loss"))


def merge_configs(steps: DataFrame, values: Sequence[str]) -> DataFrame:
    """One configuration per run with 'step:parameter' keys, and its most frequent origin.

    A run has as many rows as steps. On ties the origin seen first wins.
    """
    pairs = F.array(*[
        F.struct(F.concat_ws(":", F.col("step_no").cast("string"), F.lit(v)).alias("k"), F.col(v).alias("v"))
        for v in values
    ])
    config = steps.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.flatten(F.collect_list(pairs)))).alias("config"))
    votes = steps.groupBy("run_id", "origin").agg(F.count("*").alias("n"), F.min("step_no").alias("first"))
    origin = votes.groupBy("run_id").agg(F.min_by("origin", F.struct(-F.col("n"), F.col("first"))).alias("origin"))
    return config.join(origin, "run_id")


def fill_missing_steps(structure_steps: DataFrame, logged: DataFrame, space: dict[str, tuple[float, float]], seed: int = 0) -> DataFrame:
    """Logged step configurations plus a random one for every step without a log line.

    Wanted and logged steps meet in one grouping, without a join; a step without a full key equals no logged one.
    """
    keys = ["run_id", "step_no"]
    marked = structure_steps.select(*keys, F.lit(1).alias("_wanted"), F.lit(0).alias("_logged")).unionAll(
        logged.select(*keys, F.lit(0).alias("_wanted"), F.lit(1).alias("_logged")))
    each = marked.groupBy(*keys).agg(F.max("_wanted").alias("_wanted"), F.max("_logged").alias("_logged"))
    missing = each.where("_wanted = 1 AND (_logged = 0 OR run_id IS NULL OR step_no IS NULL)")
    drawn = [
        (lo + draws.uniform(f"{seed}{name}", *keys) * (hi - lo)).alias(name) for name, (lo, hi) in space.items()
    ]
    filled = missing.select(*keys, *drawn, F.lit("Random Search").alias("origin"))
    return logged.select(*keys, *space, "origin").unionByName(filled)


def leaderboard(scores: DataFrame, k: int, score: str = "loss", ident: str = "structure") -> DataFrame:
    return scores.orderBy(score, ident).limit(k)


def random_tie_break(rows: DataFrame, keys: Sequence[str], score: str, ident: str, seed: int = 0) -> DataFrame:
    """A uniform pick among the rows with the smallest score."""
    draw = draws.uniform(seed, *keys, ident)
    return rows.groupBy(*keys).agg(
        F.min(score).alias(score), F.min_by(ident, F.struct(F.col(score), draw, F.col(ident))).alias(ident))


def structure_cap(proposals: DataFrame, cap: int = 200) -> DataFrame:
    return proposals.orderBy("first_ts", "structure").limit(cap)


def distinct_structures(chains: DataFrame) -> DataFrame:
    """Structures with equal configuration spaces are one; a space is the sorted list of its steps."""
    space = F.array_join(F.array_sort("steps"), ",")
    return chains.groupBy(F.sha2(space, 256).alias("space_hash")).agg(
        F.min("chain").alias("chain"), F.count("*").alias("n_chains"))
