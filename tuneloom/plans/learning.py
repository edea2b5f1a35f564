"""Components and evaluation jobs on Spark ML."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml import feature as FT
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tuneloom.evaluation import components as K
from tuneloom.evaluation import jobs as J
from tuneloom.operators import ensemble as E
from tuneloom.operators import metrics, splits
from tuneloom.operators import quantiles as Q
from tuneloom.plans.history import r6
from tuneloom.plans.registry import query
from tuneloom.session import new_path
from tuneloom.sources import views as V

LINE_NUMERIC = ("quantity", "discount", "tax")


def line_rows(spark, d):
    """Order lines: three numbers, a category, label is the line status."""
    lines = V._lines(spark, d)
    return lines.select(
        "row_id", *LINE_NUMERIC, F.col("flag"), (F.col("status") == "O").cast("double").alias("label"))


def line_task(spark, d, metric="f1"):
    return J.Task(line_rows(spark, d), LINE_NUMERIC, ("flag",), (0, 1), metric)


def doc_task(spark, d, metric="f1"):
    """Labelled documents: length, language and source; label is the quality."""
    docs = V.quality_docs(spark, d).select(
        F.col("doc_id").alias("row_id"), F.col("n_chars").cast("double").alias("n_chars"), "lang", "source",
        F.col("label").cast("double").alias("label"))
    return J.Task(docs, ("n_chars",), ("lang", "source"), (0, 1), metric)


def _classifier_query(key: str, steps: tuple[str, ...], params: dict | None = None):
    @query(key)
    def run(spark, d):
        task = line_task(spark, d)
        train, test = J.holdout(task)
        train = train.persist()  # read once per stage of the pipeline and per pass of the learner
        model = K.build(steps, params or {}, task.numeric, task.categorical).fit(train)
        train.unpersist()
        pred = K.predictions(model, test)
        return pred.groupBy("y", "pred").agg(F.count("*").alias("n"))
    return run


_classifier_query("bernoulli_nb", ("OneHotEncoder", "MinMaxScaler", "Binarizer", "BernoulliNB"), {"2:threshold": 0.5})
_classifier_query("multinomial_nb", ("OneHotEncoder", "MinMaxScaler", "MultinomialNB"))
_classifier_query("decision_tree", ("OneHotEncoder", "DecisionTreeClassifier"))
_classifier_query("hist_gradient_boosting", ("HistGradientBoostingClassifier",), {"0:maxIter": 5})
_classifier_query("svc", ("OneHotEncoder", "StandardScaler", "SVC"), {"2:maxIter": 30})
_classifier_query("random_forest", ("OneHotEncoder", "RandomForestClassifier"), {"1:numTrees": 10})
_classifier_query("sgd_classifier", ("OneHotEncoder", "StandardScaler", "SGDClassifier"), {"2:regParam": 0.01})


@query("simple_imputer", """
    WITH x AS (SELECT row_id, CASE WHEN flag <> 'N' THEN tax END AS tax FROM lines)
    SELECT row_id, round(coalesce(tax, (SELECT avg(tax) FROM x)), 6) AS tax FROM x""")
def simple_imputer(spark, d):
    rows = line_rows(spark, d).select("row_id", F.when(F.col("flag") != "N", F.col("tax")).alias("tax"))
    model = FT.Imputer(strategy="mean", inputCols=["tax"], outputCols=["filled"]).fit(rows)
    return model.transform(rows).select("row_id", r6("filled", "tax"))


def _parts(spark, d):
    part = V.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return part.withColumn("features", array_to_vector(F.array("a", "b")))


@query("scaling", """
    SELECT p_partkey, round(p_size / CAST(max(abs(p_size)) OVER () AS DOUBLE), 6) AS maxabs_a,
           round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS minmax_b,
           round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS norm_a,
           round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS standard_b
    FROM part""")
def scaling(spark, d):
    df = _parts(spark, d)
    for name in ("MaxAbsScaler", "MinMaxScaler", "Normalizer", "StandardScaler"):
        step = K.vector_step(name, "features", name)
        df = (step.fit(df) if hasattr(step, "fit") else step).transform(df)

    def at(col, i):
        return F.get(vector_to_array(col), F.lit(i))

    return df.select(
        "p_partkey", r6(at("MaxAbsScaler", 0), "maxabs_a"), r6(at("MinMaxScaler", 1), "minmax_b"),
        r6(at("Normalizer", 0), "norm_a"), r6(at("StandardScaler", 1), "standard_b"))


@query("robust_scaler", """
    WITH q AS (SELECT quantile_cont(p_size, [0.25e0, 0.5e0, 0.75e0]) AS a, quantile_cont(p_retailprice, [0.25e0, 0.5e0, 0.75e0]) AS b FROM part)
    SELECT p_partkey, round((p_size - a[2]) / CASE WHEN a[3] = a[1] THEN 1 ELSE a[3] - a[1] END, 6) AS a,
           round((p_retailprice - b[2]) / CASE WHEN b[3] = b[1] THEN 1 ELSE b[3] - b[1] END, 6) AS b FROM part, q""")
def robust_scaler(spark, d):
    out = Q.robust_scale(_parts(spark, d).select("p_partkey", "a", "b"), ["a", "b"])
    return out.select("p_partkey", r6("a_r", "a"), r6("b_r", "b"))


def _cuts(column):
    return f"""(SELECT list(DISTINCT x) FILTER (list_contains([CAST(ceil(i * n / 100e0) AS BIGINT) FOR i IN range(1, 100)], k)) AS cuts, min(lo) AS lo, max(hi) AS hi FROM (
      SELECT {column} AS x, row_number() OVER (ORDER BY {column}) AS k, count(*) OVER () AS n, min({column}) OVER () AS lo, max({column}) OVER () AS hi FROM part)
      )"""


def _rank(x, cuts):
    return f"len(list_filter({cuts}.cuts, lambda v: v <= {x}))"


@query("quantile_transformer", f"""
    WITH a AS {_cuts("p_size")}, b AS {_cuts("p_retailprice")}
    SELECT p_partkey, {", ".join(f"({_rank(x, t)} - {_rank(f'{t}.lo', t)}) / CAST(greatest(1, {_rank(f'{t}.hi', t)} - {_rank(f'{t}.lo', t)}) AS DOUBLE) AS {t}_q" for x, t in (("p_size", "a"), ("p_retailprice", "b")))}
    FROM part, a, b""")
def quantile_transformer(spark, d):
    return Q.rank_scale(_parts(spark, d).select("p_partkey", "a", "b"), ["a", "b"]).select("p_partkey", "a_q", "b_q")


@query("label_encoder", """
    WITH f AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS i FROM part GROUP BY p_brand)
    SELECT p_partkey, p_brand, CAST(i AS DOUBLE) AS code FROM part JOIN f USING (p_brand)""")
def label_encoder(spark, d):
    rows = V.table(spark, d, "part").select("p_partkey", "p_brand")
    model = FT.StringIndexer(inputCol="p_brand", outputCol="code", handleInvalid="keep").fit(rows)
    return model.transform(rows).select("p_partkey", "p_brand", "code")


@query("one_hot_encoder", """
    SELECT o_orderkey, CAST(o_orderstatus = s AS INTEGER) AS hit, s AS category
    FROM orders, (SELECT DISTINCT o_orderstatus AS s FROM orders)""")
def one_hot_encoder(spark, d):
    rows = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    index = FT.StringIndexer(inputCol="o_orderstatus", outputCol="code").fit(rows)
    hot = FT.OneHotEncoder(inputCols=["code"], outputCols=["hot"], dropLast=False)
    coded = index.transform(rows)
    out = hot.fit(coded).transform(coded)
    names = F.lit(list(index.labels))
    return out.select("o_orderkey", F.posexplode(vector_to_array("hot")).alias("i", "hit")).select(
        "o_orderkey", F.col("hit").cast("int").alias("hit"), F.get(names, F.col("i")).alias("category"))


def _line_vectors(spark, d):
    rows = line_rows(spark, d)
    return rows.withColumn("features", array_to_vector(F.array(
        F.col("quantity") / 50, F.col("discount") * 10, F.col("tax") * 12)))


@query("pca")
def pca(spark, d):
    df = _line_vectors(spark, d)
    model = K.pca_keeping(df, 0.7)
    return model.transform(df).select("row_id", F.size(vector_to_array("reduced")).alias("k"), F.array_join(
        F.transform(vector_to_array("reduced"), lambda x: F.round(x, 4).cast("string")), ",").alias("reduced"))


@query("truncated_svd")
def truncated_svd(spark, d):
    out, values = K.truncated_svd(_line_vectors(spark, d), 3, 2)
    arr = vector_to_array("reduced")
    return out.select("row_id", F.get(arr, F.lit(0)).alias("first"), F.get(arr, F.lit(1)).alias("second"),
                      F.lit(values[0]).alias("singular_1"), F.lit(values[1]).alias("singular_2"))


@query("feature_selection")
def feature_selection(spark, d):
    """Indices kept by the three selectors."""
    df = _line_vectors(spark, d)
    rows = []
    for name, params in (("SelectKBest", {"k": 2}), ("SelectPercentile", {"percentile": 0.5}), ("GenericUnivariateSelect", {})):
        model = K.vector_step(name, "features", "kept", **params).fit(df)
        rows.append(df.agg(F.lit(name).alias("selector"), F.lit(",".join(map(str, model.selectedFeatures))).alias("kept"), F.count("*").alias("n")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("binarizer", "SELECT p_partkey, CAST(p_retailprice > 1200 AS DOUBLE) AS high FROM part")
def binarizer(spark, d):
    rows = _parts(spark, d)
    return FT.Binarizer(threshold=1200.0, inputCol="b", outputCol="high").transform(rows).select("p_partkey", "high")


@query("kbins_discretizer", """
    SELECT p_partkey, CAST(least(4, floor((p_retailprice - lo) / ((hi - lo) / 5))) AS DOUBLE) AS bin
    FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""")
def kbins_discretizer(spark, d):
    return K.equal_width_bins(_parts(spark, d), "b", 5).select("p_partkey", F.col("b_bin").alias("bin"))


@query("polynomial_features", """
    SELECT p_partkey, round(CAST(p_size AS DOUBLE), 6) AS a, round(p_size * CAST(p_size AS DOUBLE), 6) AS aa, round(p_retailprice, 6) AS b,
           round(p_size * p_retailprice, 6) AS ab, round(p_retailprice * p_retailprice, 6) AS bb FROM part""")
def polynomial_features(spark, d):
    out = K.vector_step("PolynomialFeatures", "features", "poly").transform(_parts(spark, d))
    arr = vector_to_array("poly")
    return out.select("p_partkey", *[r6(F.get(arr, F.lit(i)), n) for i, n in enumerate(("a", "aa", "b", "ab", "bb"))])


@query("minority_coalescer", """
    SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lang) >= 0.12 * count(*) OVER () THEN lang ELSE 'other' END AS lang FROM documents""")
def minority_coalescer(spark, d):
    out = K.minority_coalescer(V.table(spark, d, "documents").select("doc_id", "lang"), "lang", 0.12)
    return out.select("doc_id", "lang")


@query("variance_threshold", """
    SELECT i, round(variance, 6) AS variance, variance > 0.08 AS kept FROM (
        SELECT 0 AS i, var_samp(quantity / 50) AS variance FROM lines UNION ALL SELECT 1 AS i, var_samp(discount * 10) AS variance FROM lines
        UNION ALL SELECT 2 AS i, var_samp(tax * 12) AS variance FROM lines)""")
def variance_threshold(spark, d):
    df = _line_vectors(spark, d)
    model = K.vector_step("VarianceThreshold", "features", "kept", threshold=0.08).fit(df)
    return K.column_variances(df).select("i", r6("variance"), F.col("i").isin(*model.selectedFeatures).alias("kept"))


@query("missing_indicator", """
    SELECT row_id, CAST(flag = 'N' AS INTEGER) AS tax_missing, CASE WHEN flag <> 'N' THEN round(tax, 6) END AS tax FROM lines""")
def missing_indicator(spark, d):
    rows = line_rows(spark, d).select("row_id", F.when(F.col("flag") != "N", F.round("tax", 6)).alias("tax"))
    return K.missing_indicator(rows, ["tax"]).select("row_id", "tax_missing", "tax")


@query("clone", "SELECT p_partkey, p_size, p_size AS p_size_copy FROM part")
def clone(spark, d):
    return V.table(spark, d, "part").select("p_partkey", "p_size", F.col("p_size").alias("p_size_copy"))


# ---- evaluation jobs

def _candidates():
    return [
        J.Candidate(0, 0, 0, J.DEFAULT_STEPS),
        J.Candidate(0, 1, 0, ("OneHotEncoder", "StandardScaler", "SGDClassifier"), {"2:regParam": 0.01}),
        J.Candidate(0, 2, 0, ("MinMaxScaler", "MultinomialNB")),
        J.Candidate(0, 3, 0, ("StandardScaler",)),  # no classifier: crashes
    ]


@query("evaluate_candidates")
def evaluate_candidates(spark, d):
    results = J.evaluate_candidates(doc_task(spark, d, "logloss"), _candidates())
    return results.select("iteration", "structure", "config", "status", "loss", "structure_loss", "message")


@query("fixed_structure")
def fixed_structure(spark, d):
    """Encoding, imputation and a decision tree, the structure used when none is searched for."""
    task = doc_task(spark, d)
    train, test = J.holdout(task)
    chosen = J.fixed_structure(1)[0]
    return K.predictions(K.build(chosen.steps, chosen.params, task.numeric, task.categorical).fit(train), test).drop("probs")


@query("out_of_fold")
def out_of_fold(spark, d):
    return J.out_of_fold(doc_task(spark, d), J.fixed_structure(1)[0]).drop("probs")


@query("stacked_features")
def stacked_features(spark, d):
    df = _line_vectors(spark, d)
    model = K.classifier("DecisionTreeClassifier", maxDepth=4).fit(df)
    out = J.stacked_features(model, df)
    return out.select("row_id", F.size(vector_to_array("stacked")).alias("width"), "prediction")


@query("model_store")
def model_store(spark, d):
    """A stored model gives the same predictions after it is read back."""
    task = doc_task(spark, d)
    train, test = J.holdout(task)
    chosen = J.fixed_structure(1)[0]
    model = K.build(chosen.steps, chosen.params, task.numeric, task.categorical).fit(train)
    path = J.store_model(model, new_path(spark, "models"), "models_0-0-0")
    return K.predictions(PipelineModel.load(path), test).drop("probs")


@query("final_score")
def final_score(spark, d):
    task = doc_task(spark, d)
    marked = splits.stratified_split(task.rows, "label", "row_id")
    train, test = marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")
    inner = J.Task(train, task.numeric, task.categorical, task.classes, task.metric)
    results = J.evaluate_candidates(inner, _candidates()[:3])
    return J.final_score(inner, train, test, results, _candidates()[:3])


@query("final_ensemble")
def final_ensemble(spark, d):
    """Stored models of a search, selected into an ensemble on a fifth of the training rows and scored on the held-out rows."""
    task = doc_task(spark, d, "accuracy")
    marked = splits.stratified_split(task.rows, "label", "row_id")
    train, test = marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")
    again = splits.stratified_split(train, "label", "row_id", share=0.2, seed=1)
    fit, choose = again.where("NOT is_test").drop("is_test"), again.where("is_test").drop("is_test")
    inner = J.Task(fit, task.numeric, task.categorical, task.classes, task.metric)
    results = J.evaluate_candidates(inner, _candidates()[:3], model_dir=new_path(spark, "models"))
    picked = E.bagged_ensemble(J.library_predictions(results, choose), task.classes, "accuracy")
    weights = {r["model_id"]: r["weight"] for r in picked.collect()}
    return metrics.loss(E.soft_vote(J.library_predictions(results, test), weights, task.classes), "accuracy", task.classes).select(
        F.lit(len(weights)).alias("n_models"), "loss")


@query("search")
def search(spark, d):
    """Successive halving over three structures."""
    structures = [J.DEFAULT_STEPS, ("OneHotEncoder", "StandardScaler", "SGDClassifier"), ("MinMaxScaler", "MultinomialNB")]
    results, _ = J.search(doc_task(spark, d), structures)
    return results.select("iteration", "structure", "config", "status", "loss", "structure_loss")


@query("performance_prior")
def performance_prior(spark, d):
    """Learned from all runs; the meta-features of a structure's dataset come from `embeddings`."""
    actions = ("click", "error", "purchase", "signup", "view")
    per = V.runs(spark, d).groupBy("structure", F.col("origin").alias("action")).agg(F.avg(-F.col("loss")).alias("performance"))
    vectors = V.vectors(spark, d).select(F.col("vec_id").alias("structure"), "mf")
    runs = per.join(vectors, "structure").withColumn("depth", (F.col("structure") % 4 + 1).cast("int"))
    ask = vectors.select(F.col("structure").alias("id"), "mf", F.explode(F.lit(list(actions))).alias("action"), F.lit(1).alias("depth"))
    return J.performance_prior(runs, ask, actions)
