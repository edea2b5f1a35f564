"""Every step of the catalogue in a pipeline, and the stages that Spark ML lacks."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tuneloom.evaluation import components as K
from tuneloom.evaluation import jobs as J
from tuneloom.evaluation import steps

STEPS = [
    "MaxAbsScaler", "MinMaxScaler", "Normalizer", "RobustScaler", "StandardScaler", "QuantileTransformer", "LabelEncoder", "PCA", "TruncatedSVD", "SelectKBest",
    "SelectPercentile", "GenericUnivariateSelect", "Binarizer", "KBinsDiscretizer", "PolynomialFeatures", "MinorityCoalescer", "VarianceThreshold", "Clone",
    "MissingIndicator", *K.CLASSIFIERS]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, None if i % 10 == 0 else float(x), float(x * y), "abc"[i % 3] if i else "rare", float(x + y > 0)) for i, (x, y) in enumerate(rng.normal(size=(120, 2)))]
    return spark.createDataFrame(data, "row_id long, x double, z double, kind string, label double").cache()


def vectors(spark, *values):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(values)], "i int, a array<double>").select("i", array_to_vector("a").alias("v"))


def made(stage, df):
    fitted = stage.fit(df) if hasattr(stage, "fit") else stage
    return [r["o"].toArray().tolist() for r in fitted.transform(df).orderBy("i").collect()]


@pytest.mark.parametrize("name", STEPS)
def test_every_step_fits_inside_a_pipeline(rows, name):
    chain = ("SimpleImputer", "OneHotEncoder", name, "DecisionTreeClassifier")
    config = {"2:maxIter": 2} if name in ("HistGradientBoostingClassifier", "SVC") else {}
    if name in ("MultinomialNB", "BernoulliNB"):
        chain, config = ("SimpleImputer", "OneHotEncoder", "MinMaxScaler", "Binarizer", name, "DecisionTreeClassifier"), {"3:threshold": 0.5}
    out = K.predictions(K.build(chain, config, ("x", "z"), ("kind",)).fit(rows), rows)
    assert out.count() == 120 and out.where("y = pred").count() > 60


def test_several_classes_with_an_inner_learner_without_probabilities(rows):
    three = rows.withColumn("label", (F.col("row_id") % 3).cast("double"))
    model = K.build(("SimpleImputer", "OneHotEncoder", "SVC", "DecisionTreeClassifier"), {"2:maxIter": 2}, ("x", "z"), ("kind",), n_classes=3).fit(three)
    assert K.predictions(model, three).count() == 120


def test_added_stages_are_stored(rows, tmp_path):
    chain = ("MinorityCoalescer", "MissingIndicator", "SimpleImputer", "QuantileTransformer", "KBinsDiscretizer", "PCA", "TruncatedSVD", "DecisionTreeClassifier")
    config = {"0:share": 0.1, "5:keep_variance": 0.9}
    model = K.build(chain, config, ("x", "z"), ("kind",)).fit(rows)
    path = J.store_model(model, str(tmp_path), "models_0-0-0")
    assert K.predictions(PipelineModel.load(path), rows).exceptAll(K.predictions(model, rows)).isEmpty()
    common = {r["kind_common"] for r in model.stages[0].transform(rows).collect()}
    assert common == {"a", "b", "c", "other"}


def test_values_of_the_vector_stages(spark):
    df = vectors(spark, (1, 5, 0), (2, 5, float("nan")), (2, 5, 4), (9, 5, 8))
    io = {"inputCol": "v", "outputCol": "o"}
    assert np.array_equal(made(steps.EqualWidthStep(size=4.0, **io), df), [[0, 0, 0], [0, 0, float("nan")], [0, 0, 2], [3, 0, 3]], equal_nan=True)
    assert np.array_equal(made(steps.QuantileStep(size=4.0, **io), df), [[0, 0, 0], [0.5, 0, float("nan")], [0.5, 0, 0.5], [1, 0, 1]], equal_nan=True)
    x = np.random.default_rng(1).normal(size=(30, 3))
    df = vectors(spark, *x)
    left, s, right = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(made(steps.TruncatedSVD(size=2.0, **io), df)), np.abs(x @ right[:2].T))
    share = np.cumsum(np.linalg.eigvalsh(np.cov(x.T))[::-1])
    for keep in (share / share[-1])[:2]:
        k = int(np.searchsorted(share / share[-1], keep - 1e-9)) + 1
        assert len(made(steps.VarianceKeepingPCA(size=float(keep) - 1e-6, **io), df)[0]) == k


@pytest.mark.parametrize("thresholds", [None, [0.9, 0.1]])
def test_multinomial_bayes_rates_rows_below_those_of_the_fit(spark, tmp_path, thresholds):
    """Rows within the range of the fit get what Spark's model gives; others the same linear function, in storage too."""
    rng = np.random.default_rng(3)
    fit = spark.createDataFrame([(i, list(map(float, v)), float(i % 3 > 0)) for i, v in enumerate(rng.random((40, 3)))], "row_id long, a array<double>, label double")
    fit = fit.withColumn("features", array_to_vector("a"))
    given = {"thresholds": thresholds} if thresholds else {}
    plain = C.NaiveBayes(modelType="multinomial", **given).fit(fit)
    model = Pipeline(stages=[K.classifier("MultinomialNB", **given)]).fit(fit)
    J.store_model(model, str(tmp_path), "bayes")
    stored = PipelineModel.load(f"{tmp_path}/bayes")
    cols = ("rawPrediction", "probability", "prediction")

    def rated(by, rows):
        return [np.hstack([r[0].toArray(), r[1].toArray(), r[2]]) for r in by.transform(rows).orderBy("row_id").select(*cols).collect()]

    assert np.allclose(rated(model, fit), rated(plain, fit), rtol=1e-12) and np.array_equal(rated(model, fit), rated(stored, fit))
    for column in cols:
        assert model.transform(fit).schema[column].dataType == plain.transform(fit).schema[column].dataType
    x = np.array([[-0.5, 0.2, 0.9], [-40, 0, 1], [2, -1, 0]])
    low = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "row_id long, a array<double>").withColumn("features", array_to_vector("a"))
    raw = x @ plain.theta.toArray().T + plain.pi.toArray()
    shares = np.exp(raw - raw.max(1, keepdims=True))
    shares /= shares.sum(1, keepdims=True)
    best = (shares / (thresholds or [1, 1])).argmax(1)[:, None]
    assert np.allclose(rated(stored, low), np.hstack([raw, shares, best]), rtol=1e-9)
    for bad in ([float("nan"), 1.0, 1.0], [-1.0, 1.0, 1.0]):
        row = spark.createDataFrame([(0, bad, 0.0)], "row_id long, a array<double>, label double").withColumn("features", array_to_vector("a"))
        with pytest.raises(Exception, match="missing values|Negative|NaN"):
            rated(model, row) if np.isnan(bad[0]) else K.classifier("MultinomialNB").fit(row)
