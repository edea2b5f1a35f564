import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tools import check
from tuneloom.evaluation import jobs as J
from tuneloom.operators import splits
from tuneloom.plans import learning

NAMES = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)]
HEAVY = {"final_ensemble", "final_score", "search", "out_of_fold", "svc"}


@pytest.fixture(scope="module")
def con(data):
    return check.duck(data)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in NAMES if n not in HEAVY])
def test_query_equals_its_sql(spark, con, data, name):
    kind, n, _, note, _ = check.compare(spark, con, data, name)
    assert kind in ("ok", "rows"), note
    assert n > 0 or name in ("wilcoxon_exact",)
    assert "TYPES" not in note, note


def test_failed_candidates_get_the_worst_loss(spark, data):
    task = learning.line_task(spark, data, "logloss")
    got = J.evaluate_candidates(task, [
        J.Candidate(0, 0, 0, ("DecisionTreeClassifier",)), J.Candidate(0, 1, 0, ("StandardScaler",)),
        J.Candidate(0, 2, 0, ("SVC",), {"0:maxIter": 2})])
    rows = {r["structure"]: r for r in got.collect()}
    assert rows[0]["status"] == "SUCCESS" and rows[0]["loss"] > 0 > rows[0]["structure_loss"]
    assert rows[1]["status"] == "CRASHED" and rows[1]["loss"] == 100.0
    assert rows[2]["status"] == "CRASHED" and "probabilities" in rows[2]["message"]


def _labelled(spark, folder, shortest=(), unknown=()):
    """Tables of 150 documents, two thirds of good quality; `shortest` have one character, the length of `unknown` is missing."""
    docs = spark.range(150).select(
        F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.concat(F.lit("l"), F.col("id") % 2).alias("lang"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"),
        F.when(F.col("id").isin(list(unknown)), None).when(F.col("id").isin(list(shortest)), 1).otherwise(100 + F.col("id") * 37 % 500).alias("n_chars"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.range(150).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, 1).otherwise(0).alias("quality")).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def _chosen_and_held_out(spark, folder):
    """A document that the ensemble is selected on and one that it is scored on."""
    marked = splits.stratified_split(learning.doc_task(spark, folder).rows, "label", "row_id").cache()
    again = splits.stratified_split(marked.where("NOT is_test").drop("is_test"), "label", "row_id", share=0.2, seed=1)
    return [df.where("is_test").agg(F.min("row_id")).first()[0] for df in (again, marked)]


def test_an_ensemble_rates_documents_shorter_than_all_it_was_fitted_on(spark, tmp_path):
    """Their scaled length is below zero, where Spark's Naive Bayes ends the job."""
    ids = _chosen_and_held_out(spark, _labelled(spark, tmp_path / "plain"))
    row = learning.final_ensemble(spark, _labelled(spark, tmp_path / "short", shortest=ids)).first()
    assert row["n_models"] >= 1 and -1 <= row["loss"] < 0


def test_an_ensemble_of_the_only_candidate_that_succeeds(spark, tmp_path):
    """Missing lengths make the two candidates crash that don't impute."""
    row = learning.final_ensemble(spark, _labelled(spark, tmp_path, unknown=range(0, 150, 7))).first()
    assert row["n_models"] == 1 and -1 <= row["loss"] < 0


def test_time_limit(spark, data):
    task = learning.line_task(spark, data)
    got = J.evaluate_candidates(task, [J.Candidate(0, 0, 0, ("HistGradientBoostingClassifier",), {"0:maxIter": 200})], cutoff=1.0)
    assert got.first()["status"] == "TIMEOUT"


def test_each_candidate_has_its_own_time_limit(spark, data):
    """One slow candidate among quick ones, one after another: only the slow one is stopped."""
    task = learning.line_task(spark, data)
    quick, slow = ("DecisionTreeClassifier",), ("HistGradientBoostingClassifier",)
    got = J.evaluate_candidates(task, [J.Candidate(0, 0, 0, quick), J.Candidate(0, 1, 0, slow, {"0:maxIter": 400}), J.Candidate(0, 2, 0, quick)], cutoff=15.0, parallel=1)
    rows = {r["structure"]: r for r in got.collect()}
    assert [rows[k]["status"] for k in range(3)] == ["SUCCESS", "TIMEOUT", "SUCCESS"]
    assert 15 <= rows[1]["training_time"] < 20 and rows[2]["training_time"] < 15


def test_no_task_collects_a_hot_group(spark):
    """A third of all runs in one structure: its rows are spread over several ranges."""
    from tuneloom.operators import runs as R
    from tuneloom.operators import skew

    log = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("structure"), F.col("id").alias("config"),
        F.timestamp_seconds(F.col("id")).alias("ts"))
    n = R.reindex_runs(log).where("structure = 7").agg(F.count("*"), F.max("position")).first()
    assert n[0] == n[1] + 1
    assert skew.range_count(log, 1 << 14) > 9
    sizes = skew.dealt(log, ["structure", "ts", "config"], skew.range_count(log, 1 << 14)).where("structure = 7").groupBy("_range").count().collect()
    assert len(sizes) >= 3
