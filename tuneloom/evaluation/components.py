"""Component catalogue: the known step names as Spark ML stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import feature as FT
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.evaluation import steps

# Parameter ranges per component: (lower, upper, log) or a list of choices; the first choice is the default.
SPACES = {
    "BernoulliNB": {"smoothing": (0.01, 10.0, True)},
    "MultinomialNB": {"smoothing": (0.01, 10.0, True)},
    "DecisionTreeClassifier": {"maxDepth": (2, 8, False), "minInstancesPerNode": (1, 20, False)},
    "RandomForestClassifier": {"numTrees": (5, 20, False), "maxDepth": (2, 6, False)},
    "HistGradientBoostingClassifier": {"maxIter": (3, 8, False), "stepSize": (0.05, 0.3, True)},
    "SVC": {"regParam": (1e-4, 1.0, True)},
    "SGDClassifier": {"regParam": (1e-4, 1.0, True), "elasticNetParam": (0.0, 1.0, False)},
    "KBinsDiscretizer": {},
    "PCA": {"keep_variance": (0.5, 1.0, False)},
}
WHOLE = {"maxDepth", "minInstancesPerNode", "numTrees", "maxIter"}
CLASSIFIERS = ("BernoulliNB", "MultinomialNB", "DecisionTreeClassifier", "HistGradientBoostingClassifier", "SVC",
               "RandomForestClassifier", "SGDClassifier")
#: Steps that work on the columns before they stand in one vector, or need no stage.
ON_COLUMNS = {"OneHotEncoder", "SimpleImputer", "MinorityCoalescer", "MissingIndicator", "LabelEncoder", "Clone"}


def classifier(name: str, features: str = "features", label: str = "label", n_classes: int = 2, **params):
    """A classifier; two-class learners are wrapped one against the rest for more classes."""
    base = dict(featuresCol=features, labelCol=label, **params)
    if name == "BernoulliNB":
        return C.NaiveBayes(modelType="bernoulli", **base)
    if name == "MultinomialNB":
        return steps.MultinomialNB(modelType="multinomial", **base)
    if name == "DecisionTreeClassifier":
        return C.DecisionTreeClassifier(seed=42, **base)
    if name == "RandomForestClassifier":
        return C.RandomForestClassifier(seed=42, **base)
    if name == "SGDClassifier":
        return C.LogisticRegression(**base)
    if name in ("HistGradientBoostingClassifier", "SVC"):
        one = C.GBTClassifier(seed=42, **base) if name != "SVC" else C.LinearSVC(**base)
        return one if n_classes == 2 else C.OneVsRest(classifier=one, featuresCol=features, labelCol=label)
    raise ValueError(f"unknown classifier {name}")


def vector_step(name: str, features: str, out: str, label: str = "label", **params):
    """A step from one vector column to another."""
    io = dict(inputCol=features, outputCol=out)
    if name == "MaxAbsScaler":
        return FT.MaxAbsScaler(**io)
    if name == "MinMaxScaler":
        return FT.MinMaxScaler(**io)
    if name == "Normalizer":
        return FT.Normalizer(p=2.0, **io)
    if name == "RobustScaler":
        return FT.RobustScaler(withCentering=True, withScaling=True, **io)
    if name == "StandardScaler":
        return FT.StandardScaler(withMean=True, withStd=True, **io)
    if name == "PolynomialFeatures":
        return FT.PolynomialExpansion(degree=params.get("degree", 2), **io)
    if name == "VarianceThreshold":
        return FT.VarianceThresholdSelector(featuresCol=features, outputCol=out, varianceThreshold=params.get("threshold", 0.0))
    if name in ("SelectKBest", "SelectPercentile", "GenericUnivariateSelect"):
        mode, size = {"SelectKBest": ("numTopFeatures", params.get("k", 2)),
                      "SelectPercentile": ("percentile", params.get("percentile", 0.5)),
                      "GenericUnivariateSelect": (params.get("mode", "fpr"), params.get("param", 0.05))}[name]
        chosen = FT.UnivariateFeatureSelector(featuresCol=features, outputCol=out, labelCol=label, selectionMode=mode)
        return chosen.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(size)
    if name == "PCA":
        if "k" in params:
            return FT.PCA(k=params["k"], **io)
        return steps.VarianceKeepingPCA(size=params.get("keep_variance", 0.9999), **io)
    if name == "TruncatedSVD":
        return steps.TruncatedSVD(size=float(params.get("k", 2)), **io)
    if name == "QuantileTransformer":
        return steps.QuantileStep(size=float(params.get("n_quantiles", 100)), **io)
    if name == "KBinsDiscretizer":
        return steps.EqualWidthStep(size=float(params.get("n_bins", 5)), **io)
    if name == "Binarizer":
        return FT.Binarizer(threshold=params.get("threshold", 0.0), **io)
    raise ValueError(f"unknown step {name}")


def pca_keeping(df: DataFrame, keep_variance: float, features: str = "features", out: str = "reduced"):
    """PCA with as many components as are needed to keep a share of the variance."""
    return steps.VarianceKeepingPCA(inputCol=features, outputCol=out, size=keep_variance).fit(df)


def truncated_svd(df: DataFrame, n_features: int, k: int, features: str = "features", out: str = "reduced") -> tuple[DataFrame, list[float]]:
    """Projection on the first k right singular vectors, and the singular values."""
    model = steps.TruncatedSVD(inputCol=features, outputCol=out, size=float(k)).fit(df)
    _, values = steps.singular_vectors(df, n_features, k, features)
    return model.transform(df), values.tolist()


def equal_width_bins(df: DataFrame, col: str, n: int) -> DataFrame:
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None or lo == hi:
        return df.withColumn(f"{col}_bin", F.when(F.col(col).isNotNull(), 0.0))
    cuts = [-float("inf"), *[lo + (hi - lo) * i / n for i in range(1, n)], float("inf")]
    return FT.Bucketizer(splits=cuts, inputCol=col, outputCol=f"{col}_bin").transform(df)


def minority_coalescer(df: DataFrame, col: str, least_share: float, other: str = "other") -> DataFrame:
    """Rare categories become one. Only the frequent ones are looked up: at most 1 / share of them."""
    counts = df.groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*")).scalar()
    frequent = counts.where(F.col("_n") >= least_share * total).select("_v")
    joined = df.join(F.broadcast(frequent), F.col(col).eqNullSafe(F.col("_v")), "left")
    return joined.withColumn(col, F.coalesce("_v", F.lit(other))).drop("_v")


def missing_indicator(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": (F.col(c).isNull() | F.isnan(c)).cast("int") for c in cols})


def column_variances(df: DataFrame, features: str = "features") -> DataFrame:
    return df.select(Summarizer.variance(F.col(features)).alias("v")).select(F.posexplode(vector_to_array("v")).alias("i", "variance"))


def build(chain: Sequence[str], config: dict, numeric: Sequence[str], categorical: Sequence[str], n_classes: int = 2) -> Pipeline:
    """A pipeline of named steps. Columns are encoded and imputed first, the other steps work on the vector.

    Categories always become numbers (`LabelEncoder`), and `Clone` hands on what it gets: neither adds a stage.
    """
    if not chain or chain[-1] not in CLASSIFIERS:
        raise ValueError("the last step has to be a classifier")

    def params_of(i: int) -> dict:
        return {k.split(":", 1)[1]: v for k, v in config.items() if k.startswith(f"{i}:")}

    stages, inputs, indexed, flags = [], list(numeric), [], []
    if categorical:
        values = list(categorical)
        if "MinorityCoalescer" in chain:
            values = [f"{c}_common" for c in categorical]
            stages.append(steps.MinorityCoalescer(inputCols=list(categorical), outputCols=values, **params_of(chain.index("MinorityCoalescer"))))
        indexed = [f"{c}_index" for c in categorical]
        stages.append(FT.StringIndexer(inputCols=values, outputCols=indexed, handleInvalid="keep"))
        if "OneHotEncoder" in chain:
            hot = [f"{c}_hot" for c in categorical]
            stages.append(FT.OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep"))
            indexed = hot
    if "MissingIndicator" in chain and numeric:
        flags = [f"{c}_missing" for c in numeric]
        says = ", ".join(f"CAST(`{c}` IS NULL OR isnan(`{c}`) AS DOUBLE) AS `{f}`" for c, f in zip(numeric, flags, strict=True))
        stages.append(FT.SQLTransformer(statement=f"SELECT *, {says} FROM __THIS__"))
    if "SimpleImputer" in chain and numeric:
        inputs = [f"{c}_imp" for c in numeric]
        stages.append(FT.Imputer(strategy="mean", inputCols=list(numeric), outputCols=inputs))
    stages.append(FT.VectorAssembler(inputCols=inputs + indexed + flags, outputCol="features_0", handleInvalid="keep"))
    current = "features_0"
    for i, step in enumerate(chain[:-1]):
        if step in ON_COLUMNS:
            continue
        if step in CLASSIFIERS:
            model = classifier(step, current, n_classes=n_classes, **params_of(i)).setPredictionCol(f"prediction_{i}").setRawPredictionCol(f"raw_{i}")
            rated = f"raw_{i}"
            if isinstance(model, C.OneVsRest):
                # it reads the raw predictions of its learners under its own name for them
                model.getClassifier().setRawPredictionCol(rated)
            if hasattr(model, "setProbabilityCol"):
                rated = f"probability_{i}"
                model = model.setProbabilityCol(rated)
            stages += [model, FT.VectorAssembler(inputCols=[current, rated, f"prediction_{i}"], outputCol=f"features_{i + 1}")]
        else:
            stages.append(vector_step(step, current, f"features_{i + 1}", **params_of(i)))
        current = f"features_{i + 1}"
    stages.append(classifier(chain[-1], current, n_classes=n_classes, **params_of(len(chain) - 1)))
    return Pipeline(stages=stages)


def predictions(model: PipelineModel, df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, y, pred, probs) of a fitted pipeline; `probs` is missing for learners without probabilities."""
    out = model.transform(df)
    cols = [F.col(key), F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("probs"))
    return out.select(*cols)
