"""Ensembles from a table of predictions: bags, greedy selection and votes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.functions import draws, names, scores
from tuneloom.operators import metrics
from tuneloom.session import cut_lineage

#: Rows that a task blends at once.
CHUNK_ROWS = 4096
#: Probabilities of a task's rows, of distinct rows put together.
TASK_VALUES = 1_000_000
#: Digits of a loss that decide; further ones depend on the order of sums.
DIGITS = 12


def score_library(preds: DataFrame, classes: Sequence, metric: str = "logloss") -> DataFrame:
    """Loss of every model on the held-out rows; a model with missing predictions counts as failed."""
    failed = preds.groupBy("model_id").agg(
        F.count_if(F.col("probs").isNull() | F.exists("probs", lambda p: p.isNull())).alias("n_missing"))
    score = metrics.loss(preds.where("probs IS NOT NULL"), metric, classes, ["model_id"])
    joined = failed.join(score, "model_id", "left")
    ok = F.col("n_missing") == 0
    return joined.select("model_id", F.when(ok, F.col("loss")).alias("loss"), (~ok).alias("failed"))


def model_bags(models: DataFrame, n_bags: int = 4, share: float = 0.75, seed: int = 0) -> DataFrame:
    """Bags of floor(share * n) models, one at least, without replacement. One row per model, so the table is small."""
    n = models.agg(F.count("*")).scalar()
    bags = models.select("model_id", F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1))).alias("bag"))
    order = Window.partitionBy("bag").orderBy(draws.uniform(seed, "bag", "model_id"), "model_id")
    placed = bags.withColumn("_rn", F.row_number().over(order))
    return placed.where(F.col("_rn") <= F.greatest(F.lit(1), F.floor(n * share))).select("bag", "model_id")


def wide_predictions(preds: DataFrame, n_models: int | None = None) -> DataFrame:
    """One row per data row with all models' probabilities, in model order.

    The array is as long as the model library. With `n_models`, a row some model has
    no prediction for is an error: its array would not line up with the models.
    """
    wide = preds.groupBy("row_id").agg(
        F.first("y").alias("y"),
        F.transform(F.array_sort(F.collect_list(F.struct("model_id", "probs"))), lambda s: s["probs"]).alias("library"))
    return wide if n_models is None else _whole(wide, n_models)


def _whole(wide: DataFrame, n_models: int) -> DataFrame:
    whole = (F.size("library") == n_models) & ~F.exists("library", lambda p: p.isNull())
    text = F.concat(F.lit("a model has no prediction for row "), F.col("row_id").cast("string"))
    return wide.withColumn("library", F.when(whole, F.col("library")).otherwise(
        F.raise_error(text).cast("array<array<double>>")))


def round_losses(wide: DataFrame, models: Sequence, classes: Sequence, metric: str,
                 weights: dict[int, dict], candidates: dict[int, Sequence]) -> DataFrame:
    """Loss per (bag, candidate model) when the candidate joins the bag's weighted models.

    The blend of a bag follows from its weights, so a round is one scan without
    a join and without state from the round before.
    """
    at = {m: i for i, m in enumerate(models)}
    entries = []
    for bag, members in candidates.items():
        chosen = weights.get(bag, {})
        n = float(sum(chosen.values()))
        blended = [
            " + ".join([f"library[{at[m]}][{c}] * {float(w)}D" for m, w in chosen.items()] or ["0.0D"])
            for c in range(len(classes))]
        entries += [
            (bag, m, [f"({blended[c]} + library[{at[m]}][{c}]) / {n + 1.0}D" for c in range(len(classes))])
            for m in members]
    array = ", ".join(
        f"named_struct('bag', {b}, 'model_id', {m!r}, 'probs', array({', '.join(ps)}))" for b, m, ps in entries)
    long = wide.select("y", F.expr(f"explode(array({array}))").alias("_e")).select("y", "_e.*")
    return metrics.loss(long, metric, classes, ["bag", "model_id"])


def truth_rows(preds: DataFrame, n_models: int, classes: Sequence) -> DataFrame:
    """Distinct rows of the probabilities that the models, in their order, give the true class, and how many rows are alike.

    Each model's probabilities are taken as shares of their sum, and only the true class's share goes into the row's array.
    Like rows are put together before anything is written. `preds` is long, or wide as from `wide_predictions`.
    """
    slot = F.coalesce(*[F.when(F.col("y") == F.lit(c), F.lit(i)) for i, c in enumerate(classes)])

    def share(probs: Column) -> Column:
        return F.get(probs, slot) / F.aggregate(probs, F.lit(0.0), lambda s, x: s + x)

    if "library" in preds.columns:
        rows = _whole(preds, n_models).select(F.transform("library", share).alias("truth"))
    else:
        of_true = preds.withColumn("probs", F.when(F.col("probs").isNotNull(), F.array(share(F.col("probs")))))
        rows = wide_predictions(of_true, n_models).select(F.transform("library", lambda p: F.get(p, F.lit(0))).alias("truth"))
    alike = cut_lineage(rows.groupBy("truth").agg(F.count("*").alias("n")))
    return alike.coalesce(max(1, -(-alike.count() * n_models // TASK_VALUES)))


def round_log_losses(truth: DataFrame, weights: dict[int, np.ndarray], members: dict[int, np.ndarray], eps: float = metrics.EPS) -> DataFrame:
    """Log loss per (bag, place of a model among all) when that member of the bag joins its weighted models.

    A task blends the true class's probabilities of its rows per bag, once for all candidates, and sends on one array of
    sums per bag. The plan is the same in every round, whatever the number of models and bags.
    """
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = {b: np.zeros(len(m)) for b, m in members.items()}, 0.0
        for batch in batches:
            n = batch.column("n").to_numpy().astype(float)
            each = batch.column("truth").flatten().to_numpy().reshape(len(n), -1) if len(n) else np.empty((0, 0))
            for begin in range(0, len(n), CHUNK_ROWS):
                part, count = each[begin:begin + CHUNK_ROWS], n[begin:begin + CHUNK_ROWS]
                rows += count.sum()
                for bag, own in members.items():
                    total = weights[bag].sum() + 1
                    p = (part @ weights[bag])[:, None] + part[:, own]
                    sums[bag] -= count @ np.log(np.clip(p / total, eps, 1 - eps))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64())), pa.array([rows] * len(sums))], names=["bag", "sums", "rows"])

    part = truth.mapInArrow(add_up, "bag int, sums array<double>, rows double").select("bag", "rows", F.posexplode("sums").alias("at", "s"))
    return part.groupBy("bag", "at").agg((F.sum("s") / F.sum("rows")).alias("loss"))


def greedy_selection(preds: DataFrame, bags: DataFrame, classes: Sequence, metric: str = "logloss",
                     max_models: int = 25, seed: int = 0, models: DataFrame | None = None) -> DataFrame:
    """Forward selection with replacement in every bag; the best round is kept.

    Only the losses of a round (bags x models numbers) reach the driver. Ties, to 12 digits, are
    broken by a draw on (seed, round, bag, model). Returns (bag, model_id, weight, loss).

    `models` holds the library's model_id where they are known; without it they are found by a pass over `preds`.
    With it, `preds` may be wide: (row_id, y, library), the library in the order of model_id.
    """
    spark = preds.sparkSession
    model_type = dict((preds if models is None else models).dtypes)["model_id"]
    models = sorted(r[0] for r in (preds if models is None else models).select("model_id").distinct().collect())
    place = {m: i for i, m in enumerate(models)}
    members: dict[int, list] = {}
    for r in bags.collect():
        members.setdefault(r["bag"], []).append(r["model_id"])
    members = {b: sorted(ms) for b, ms in sorted(members.items())}
    places = {b: np.array([place[m] for m in ms]) for b, ms in members.items()}
    if metric == "logloss":
        wide = truth_rows(preds, len(models), classes)
    else:
        wide = cut_lineage(_whole(preds, len(models)) if "library" in preds.columns else wide_predictions(preds, len(models)))
    rounds = 0 if wide.isEmpty() else max_models

    def draw(*parts) -> str:
        return hashlib.md5("|".join(str(x) for x in (seed, *parts)).encode()).hexdigest()

    weights: dict[int, dict] = {b: {} for b in members}
    best: dict[int, tuple] = {}
    for step in range(rounds):
        if metric == "logloss":
            vectors = {b: np.array([float(chosen.get(m, 0)) for m in models]) for b, chosen in weights.items()}
            found = [(r["bag"], members[r["bag"]][r["at"]], r["loss"]) for r in round_log_losses(wide, vectors, places).collect()]
        else:
            found = [(r["bag"], r["model_id"], r["loss"]) for r in round_losses(wide, models, classes, metric, weights, members).collect()]
        winner: dict[int, tuple] = {}
        for bag, model, loss in found:
            key = (round(loss, DIGITS), draw(step, bag, model), model)
            winner[bag] = min(winner.get(bag, key), key)
        for bag, (loss, _, m) in winner.items():
            weights[bag][m] = weights[bag].get(m, 0) + 1
            if bag not in best or loss < best[bag][0]:
                best[bag] = (loss, dict(weights[bag]))
    rows = [(b, m, w, loss) for b, (loss, chosen) in best.items() for m, w in sorted(chosen.items())]
    return spark.createDataFrame(rows, f"bag int, model_id {model_type}, weight int, loss double")


def bagged_ensemble(preds: DataFrame, classes: Sequence, metric: str = "logloss", n_bags: int = 4,
                    share: float = 0.75, max_models: int = 25, seed: int = 0, models: DataFrame | None = None) -> DataFrame:
    """Greedy selection in every bag; the bag with the smallest loss wins. `models` and `preds` as in `greedy_selection`."""
    if models is None:
        models = cut_lineage(preds.select("model_id").distinct())
    bags = model_bags(models, n_bags, share, seed)
    picked = greedy_selection(preds, bags, classes, metric, max_models, seed, models)
    best = picked.agg(F.min(F.struct("loss", "bag")).alias("b")).select("b.bag")
    return picked.join(best, "bag", "left_semi")


def _weight(weights: dict):
    return F.coalesce(F.try_element_at(names.lookup({m: float(w) for m, w in weights.items()}), F.col("model_id")), F.lit(0.0))


def soft_vote(preds: DataFrame, weights: dict, classes: Sequence) -> DataFrame:
    """Weighted mean of the probabilities and the class of the largest one."""
    used = preds.withColumn("_w", _weight(weights)).where("_w > 0")
    sums = [F.sum(F.col("_w") * F.get("probs", F.lit(i))) / F.sum("_w") for i in range(len(classes))]
    voted = used.groupBy("row_id").agg(F.first("y").alias("y"), F.array(*sums).alias("probs"))
    return voted.withColumn("pred", metrics.argmax("probs", classes))


def hard_vote(preds: DataFrame, weights: dict, classes: Sequence) -> DataFrame:
    """Weighted majority of the predicted classes; the first class on ties."""
    used = preds.withColumn("_w", _weight(weights)).where("_w > 0")
    if "pred" not in used.columns:
        used = used.withColumn("pred", metrics.argmax("probs", classes))
    votes = [F.sum(F.when(F.col("pred") == F.lit(c), F.col("_w")).otherwise(0.0)) for c in classes]
    voted = used.groupBy("row_id").agg(F.first("y").alias("y"), F.array(*votes).alias("votes"))
    return voted.withColumn("pred", metrics.argmax("votes", classes))


def ensemble_score(preds: DataFrame, weights: dict, classes: Sequence, metric: str) -> DataFrame:
    """Loss of the soft vote; the worst loss of the metric when no model has weight."""
    if not any(w > 0 for w in weights.values()):
        return preds.limit(1).agg(F.lit(scores.worst_loss_of(metric)).alias("loss"))
    return metrics.loss(soft_vote(preds, weights, classes), metric, classes)
