"""Evaluation of candidates as Spark ML jobs.

The driver loops over candidates, a short table; every fit and every score is a
distributed job, and only scores come back.
"""

from __future__ import annotations

import random
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.evaluation import components as K
from tuneloom.functions import draws, scores
from tuneloom.operators import metrics, splits

RESULT_SCHEMA = (
    "iteration int, structure int, config int, status string, loss double, structure_loss double, "
    "training_time double, model_path string, message string")
# Fixed values of the performance model.
VARIANCE_FLOOR = 0.01
#: How often the time limits of running candidates are looked at.
POLL_SECONDS = 0.2


@dataclass(frozen=True)
class Task:
    """What is learned: rows with key and label, feature columns, classes and the user's metric."""

    rows: DataFrame
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    classes: tuple[int, ...] = (0, 1)
    metric: str = "f1"
    key: str = "row_id"


@dataclass(frozen=True)
class Candidate:
    iteration: int
    structure: int
    config: int
    steps: tuple[str, ...]
    params: dict = field(default_factory=dict)


# The structure used when none is searched for.
DEFAULT_STEPS = ("OneHotEncoder", "SimpleImputer", "DecisionTreeClassifier")


def fixed_structure(count: int, steps: Sequence[str] = DEFAULT_STEPS) -> list[Candidate]:
    """The same structure for every candidate."""
    return [Candidate(0, i, 0, tuple(steps)) for i in range(count)]


def default_config(steps: Sequence[str]) -> dict:
    """Empty: every component keeps its own defaults."""
    return {}


def random_config(steps: Sequence[str], seed: int) -> dict:
    """One uniform draw per parameter of the chain, named 'step:parameter'."""
    rng = random.Random(seed)
    out = {}
    for i, step in enumerate(steps):
        for name, (lo, hi, log) in K.SPACES.get(step, {}).items():
            x = lo * (hi / lo) ** rng.random() if log else lo + (hi - lo) * rng.random()
            out[f"{i}:{name}"] = int(round(x)) if name in K.WHOLE else x
    return out


def score(pred: DataFrame, task: Task) -> tuple[float, float]:
    """(loss in the task's metric, weighted F1 loss); both smaller is better."""
    if task.metric in ("logloss", "roc_auc") and "probs" not in pred.columns:
        raise ValueError(f"{task.metric} needs probabilities")
    f1 = metrics.loss(pred, "f1", task.classes, pred="pred").first()["loss"]
    if task.metric == "f1":
        return f1, f1
    return metrics.loss(pred, task.metric, task.classes, pred="pred").first()["loss"], f1


def holdout(task: Task) -> tuple[DataFrame, DataFrame]:
    marked = splits.holdout_split(task.rows, task.key)
    return marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")


def evaluate_candidates(task: Task, candidates: Sequence[Candidate], cutoff: float | None = None, parallel: int = 3,
                        model_dir: str | None = None) -> DataFrame:
    """Fits every candidate on the training rows and scores it on the held-out ones.

    A failing candidate is CRASHED. One that runs for more than `cutoff` seconds, counted from its own
    start, is TIMEOUT and its jobs are cancelled. Both get the worst loss.
    """
    spark = task.rows.sparkSession
    sc = spark.sparkContext
    train, test = (part.persist() for part in holdout(task))
    begun: dict[int, float] = {}

    def group(c: Candidate) -> str:
        return f"candidate-{id(task)}-{c.iteration}-{c.structure}-{c.config}"

    def run(k: int, c: Candidate):
        sc.setJobGroup(group(c), f"candidate {c.iteration}:{c.structure}:{c.config}", interruptOnCancel=True)
        begun[k] = time.monotonic()
        pipe = K.build(c.steps, c.params, task.numeric, task.categorical, len(task.classes))
        model = pipe.fit(train)
        loss, structure_loss = score(K.predictions(model, test, task.key), task)
        path = None
        if model_dir:
            path = f"{model_dir}/models_{c.iteration}-{c.structure}-{c.config}"
            model.write().save(path)
        return loss, structure_loss, time.monotonic() - begun[k], path

    worst = (scores.worst_loss_of(task.metric), scores.WORST_STRUCTURE)
    late: dict[int, float] = {}
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(run), k, c) for k, c in enumerate(candidates)]
        open_ = set(futures)
        while open_:
            _, open_ = wait(open_, timeout=None if cutoff is None else POLL_SECONDS)
            for k, c in enumerate(candidates):
                if futures[k] in open_ and k in begun and cutoff is not None and time.monotonic() - begun[k] > cutoff:
                    # again until it ends: a fit starts many jobs
                    late.setdefault(k, time.monotonic() - begun[k])
                    sc.cancelJobGroup(group(c))
    train.unpersist()
    test.unpersist()
    results = []
    for k, (c, future) in enumerate(zip(candidates, futures, strict=True)):
        head = (c.iteration, c.structure, c.config)
        ex = future.exception()
        if k in late:
            results.append((*head, "TIMEOUT", *worst, late[k], None, "time limit"))
        elif ex is None:
            loss, structure_loss, spent, path = future.result()
            results.append((*head, "SUCCESS", loss, structure_loss, spent, path, None))
        else:  # any failure of a candidate is a result of the search
            results.append((*head, "CRASHED", *worst, None, None, str(ex) or type(ex).__name__))
    return spark.createDataFrame(results, RESULT_SCHEMA)


def out_of_fold(task: Task, candidate: Candidate, k: int = 4) -> DataFrame:
    """Predictions for every row from the model that did not see it."""
    folded = splits.stratified_folds(task.rows, "label", task.key, k).persist()
    parts = []
    for fold in range(k):
        pipe = K.build(candidate.steps, candidate.params, task.numeric, task.categorical, len(task.classes))
        model = pipe.fit(folded.where(F.col("fold") != fold))
        parts.append(K.predictions(model, folded.where(F.col("fold") == fold), task.key))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    counts = out.agg(F.count("*").alias("n"), F.count_distinct(task.key).alias("k")).first()
    if counts["n"] != counts["k"] or counts["n"] != task.rows.count():
        raise ValueError("the folds are not a partition of the rows")
    return out


def stacked_features(model: PipelineModel, df: DataFrame, features: str = "features", out: str = "stacked") -> DataFrame:
    """A classifier as a step: its probabilities and prediction are appended to the features."""
    return VectorAssembler(inputCols=[features, "probability", "prediction"], outputCol=out).transform(model.transform(df))


def final_score(task: Task, train: DataFrame, test: DataFrame, results: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """The incumbent, fitted again on all training rows and scored on the test rows."""
    best = results.where("status = 'SUCCESS'").agg(F.min(F.struct("loss", "iteration", "structure", "config")).alias("b")).first()["b"]
    if best is None:
        raise ValueError("no candidate succeeded")
    ident = (best["iteration"], best["structure"], best["config"])
    chosen = next(c for c in candidates if (c.iteration, c.structure, c.config) == ident)
    model = K.build(chosen.steps, chosen.params, task.numeric, task.categorical, len(task.classes)).fit(train)
    loss, structure_loss = score(K.predictions(model, test, task.key), task)
    spark = train.sparkSession
    return spark.createDataFrame(
        [(*ident, ">".join(chosen.steps), best["loss"], loss, structure_loss)],
        "iteration int, structure int, config int, steps string, validation_loss double, test_loss double, test_structure_loss double")


def store_model(model: PipelineModel, folder: str, name: str) -> str:
    path = f"{folder}/{name}"
    model.write().save(path)
    return path


def library_predictions(results: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions of every stored model, as the table ensembles are built from.

    One row of `results` per model; models are loaded by the driver, rows are rated in Spark.
    """
    out = None
    stored = results.where("model_path IS NOT NULL").select("structure", "config", "model_path").orderBy("structure", "config").collect()
    for i, r in enumerate(stored):
        part = K.predictions(PipelineModel.load(r["model_path"]), rows, key)
        if "probs" not in part.columns:
            continue
        part = part.select(F.lit(i).alias("model_id"), F.col(key).alias("row_id"), "y", "probs", "pred")
        out = part if out is None else out.unionByName(part)
    return out


def performance_prior(runs: DataFrame, ask: DataFrame, actions: Sequence[str], mf: str = "mf",
                      trees: int = 10, seed: int = 0) -> DataFrame:
    """Expected performance of an action on a dataset at a depth, with one normal draw.

    `runs` has (mf, action, depth, performance), `ask` (id, mf, action, depth). One forest
    learns the mean, a second one the squared residuals; the variance is at least 0.01.
    """
    def features(df: DataFrame) -> DataFrame:
        hot = F.array(*[(F.col("action") == a).cast("double") for a in actions], F.col("depth").cast("double"))
        return df.withColumn("features", array_to_vector(F.concat(F.col(mf), hot)))

    base = features(runs).withColumn("label", F.col("performance")).persist()
    forest = dict(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=6, seed=seed)
    mean = RandomForestRegressor(predictionCol="mean", **forest).fit(base)
    residual = mean.transform(base).withColumn("label", F.pow(F.col("label") - F.col("mean"), 2))
    var = RandomForestRegressor(predictionCol="variance", **forest).fit(residual)
    rated = var.transform(mean.transform(features(ask)))
    base.unpersist()
    variance = F.greatest(F.col("variance"), F.lit(VARIANCE_FLOOR))
    draw = F.col("mean") + F.sqrt(variance) * draws.normal(seed, "id", "action", "depth")
    return rated.select("id", "action", "depth", "mean", variance.alias("variance"), draw.alias("performance"))


def search(task: Task, structures: Sequence[Sequence[str]], eta: int = 3, max_budget: int = 3, seed: int = 0) -> tuple[DataFrame, list[Candidate]]:
    """Successive halving over structures; the budget is the number of configurations per structure.

    The first configuration of a structure is the default. Returns all results and candidates.
    """
    alive = list(range(len(structures)))
    budget, seen, results = 1, {i: 0 for i in alive}, None
    tried: list[Candidate] = []
    while alive:
        batch = []
        for i in alive:
            for config in range(seen[i], budget):
                steps = tuple(structures[i])
                params = default_config(steps) if config == 0 else random_config(steps, seed * 1009 + i * 101 + config)
                batch.append(Candidate(0, i, config, steps, params))
            seen[i] = budget
        tried += batch
        part = evaluate_candidates(task, batch)
        results = part if results is None else results.unionByName(part)
        if budget >= max_budget:
            break
        order = results.groupBy("structure").agg(F.min("loss").alias("loss")).where(F.col("structure").isin(alive))
        keep = max(1, len(alive) // eta)
        alive = [r["structure"] for r in order.orderBy("loss", "structure").limit(keep).collect()]
        budget = min(budget * eta, max_budget)
    return results, tried

