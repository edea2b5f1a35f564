import math

import pytest
from pyspark.sql import functions as F

from tuneloom.functions import draws, ids, names, normal, scores


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_candidate_ids(spark):
    r = one(spark, ids.parse_candidate_id(F.lit("01:02")).alias("a"), ids.parse_candidate_id(F.lit("01:02:03")).alias("b"),
            ids.format_candidate_id(F.lit(1), F.lit(2), F.lit(None).cast("int")).alias("c"),
            ids.format_candidate_id(F.lit(1), F.lit(2), F.lit(3)).alias("d"),
            ids.id_from_model_file(F.lit("/x/models_4-5-6.pkl")).alias("e"))
    assert tuple(r["a"]) == (1, 2, None) and tuple(r["b"]) == (1, 2, 3)
    assert (r["c"], r["d"]) == ("01:02", "01:02:03")
    assert tuple(r["e"]) == (4, 5, 6)


def test_model_file_name(spark):
    none = F.lit(None).cast("string")
    r = one(spark, ids.model_file_name(F.lit(1), F.lit(2), F.lit(3), none).alias("a"),
            ids.model_file_name(F.lit(1), F.lit(2), F.lit(3), F.lit("1_Random Forest!")).alias("b"))
    assert r["a"] == "models_1-2-3.pkl" and r["b"] == "step_1-random-forest.pkl"


def test_losses(spark):
    bad = spark.createDataFrame([(float("nan"), "logloss"), (float("inf"), "f1"), (None, "logloss"), (0.3, "f1")], "x double, m string")
    got = [r[0] for r in bad.select(scores.loss_or_worst(F.col("x"), F.col("m"))).collect()]
    assert got == [100.0, 0.0, 100.0, 0.3]
    assert one(spark, scores.signed_loss(F.lit(0.5), F.lit("f1")))[0] == -0.5
    assert one(spark, scores.clip_scores(F.lit(7.0), F.lit(5.0), F.lit(0.0), F.lit(-1.0)))[0] == -5.0


def test_missing_results(spark):
    df = spark.createDataFrame([(None, "auc"), (None, "logloss"), (0.7, "auc")], "r double, m string")
    assert [r[0] for r in df.select(scores.impute_missing(F.col("r"), F.col("m"))).collect()] == [0.0, 4.0, 0.7]
    with pytest.raises(Exception, match="unknown metric"):
        spark.createDataFrame([(None, "rmse")], "r double, m string").select(scores.impute_missing(F.col("r"), F.col("m"))).collect()


def test_names(spark):
    steps = F.lit([[["x"]], [["a"], ["b", "c"]], [["z"]]])
    flat = one(spark, names.flatten_branches(steps))[0]
    assert sorted(" ".join(p) for p in flat) == ["x a z", "x b c z"]
    r = one(spark, names.prefixed_names(F.lit(["a", "b"])), names.coalesce_steps(F.lit(["SVC", "PCA", "Else"])),
            names.rename_steps(F.lit(["LDA", "NoEncoding", "Own"])))
    assert r[0] == ["__ROOT", "0_a", "1_b"]
    assert r[1] == ["Classifier", "Decomposition", "Else"]
    assert r[2] == ["LinearDiscriminantAnalysis", "Own"]
    t = one(spark, names.dataset_of_task(F.lit(3913)), names.task_of_dataset(F.lit(1063)), names.task_of_name(F.lit("kc2")),
            names.task_of_name(F.lit("no")))
    assert tuple(t) == (1063, 3913, 3913, -1)


def test_normal(spark):
    df = spark.range(1, 100).select((F.col("id") / 100.0).alias("p"))
    q = normal.add_quantile(df, "p", "z").withColumn("back", normal.cdf(F.col("z"))).collect()
    assert max(abs(r["p"] - r["back"]) for r in q) < 5e-7
    assert abs(one(spark, normal.cdf(F.lit(1.959963984540054)))[0] - 0.975) < 2e-7


def test_truncated_draws_stay_inside_and_follow_the_density(spark):
    df = spark.range(20000).select("id")
    out = normal.add_truncated(df, "x", draws.uniform(3, "id"), F.lit(0.9), F.lit(0.5), 0.0, 1.0)
    r = out.agg(F.min("x"), F.max("x"), F.avg("x")).first()
    assert 0 <= r[0] and r[1] <= 1

    def pdf(z):
        return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def cdf(z):
        return 0.5 * (1 + math.erf(z / math.sqrt(2)))

    a, b = -0.9 / 0.5, 0.1 / 0.5
    assert abs(r[2] - (0.9 + 0.5 * (pdf(a) - pdf(b)) / (cdf(b) - cdf(a)))) < 0.01


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a = df.repartition(7).select("id", draws.uniform(1, "id").alias("u")).orderBy("id").collect()
    b = df.coalesce(1).select("id", draws.uniform(1, "id").alias("u")).orderBy("id").collect()
    assert a == b
    assert abs(sum(r["u"] for r in a) / 1000 - 0.5) < 0.05
