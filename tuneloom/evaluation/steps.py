"""Steps that Spark ML lacks, as stages that can be fitted, stored and read back.

What a fit learns is a table per column or per entry of the vector, never per row; it is kept as a parameter of the
fitted stage, so that the default writers of Spark ML store it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml import classification as C
from pyspark.ml import feature as FT
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol, HasInputCol, HasInputCols, HasOutputCol, HasOutputCols, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol,
    HasThresholds)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def width_of(df: DataFrame, col: str) -> int:
    """Length of the vectors of a column, 0 for an empty table."""
    first = df.select(F.size(vector_to_array(col)).alias("n")).first()
    return first["n"] if first else 0


def by_place(df: DataFrame, col: str, *aggregates: Column) -> list:
    """Aggregates of `x` over the numbers at each place of the vectors: a row per place."""
    long = df.select(F.posexplode(vector_to_array(col)).alias("place", "x")).where(~F.isnan("x"))
    found = {r["place"]: r for r in long.groupBy("place").agg(*aggregates).collect()}
    return [found.get(k) for k in range(width_of(df, col))]


class _Stage(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A stage from one vector column to another, with the size of what it makes."""

    size = Param(Params._dummy(), "size", "components, bins, cut points or share of the variance", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, size: float = 1.0) -> None:
        super().__init__()
        self._setDefault(size=1.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _columns(self) -> dict:
        return {"inputCol": self.getInputCol(), "outputCol": self.getOutputCol()}


class VarianceKeepingPCA(_Stage, Estimator):
    """Principal components, as many as keep a share `size` of the variance."""

    def _fit(self, dataset: DataFrame):
        full = FT.PCA(k=width_of(dataset, self.getInputCol()), **self._columns()).fit(dataset)
        kept = np.cumsum(full.explainedVariance.toArray())
        k = min(int(np.searchsorted(kept, self.getOrDefault(self.size) - 1e-12)) + 1, len(kept))
        return FT.PCA(k=k, **self._columns()).fit(dataset)


class TruncatedSVD(_Stage, Estimator):
    """Projection on the first `size` right singular vectors."""

    def _fit(self, dataset: DataFrame) -> VectorTable:
        vectors, _ = singular_vectors(dataset, width_of(dataset, self.getInputCol()), int(self.getOrDefault(self.size)), self.getInputCol())
        return VectorTable(kind="project", table=json.dumps(vectors.T.tolist()), **self._columns())


class QuantileStep(_Stage, Estimator):
    """Numbers to their quantile in [0, 1] by up to `size` cut points; equal cut points count once."""

    def _fit(self, dataset: DataFrame) -> VectorTable:
        n = int(self.getOrDefault(self.size))
        shares = F.lit([k / (n - 1) for k in range(n)])
        rows = by_place(dataset, self.getInputCol(), F.array_distinct(F.percentile_approx("x", shares)).alias("cuts"))
        return VectorTable(kind="quantile", table=json.dumps([r["cuts"] if r else [] for r in rows]), **self._columns())


class EqualWidthStep(_Stage, Estimator):
    """Numbers to the number of their bin, of `size` bins of equal width; constant entries get one bin."""

    def _fit(self, dataset: DataFrame) -> VectorTable:
        n = int(self.getOrDefault(self.size))
        rows = by_place(dataset, self.getInputCol(), F.min("x").alias("low"), F.max("x").alias("high"))
        cuts = [[r["low"] + (r["high"] - r["low"]) * k / n for k in range(1, n)] if r and r["low"] < r["high"] else [] for r in rows]
        return VectorTable(kind="bin", table=json.dumps(cuts), **self._columns())


class VectorTable(HasInputCol, HasOutputCol, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted steps: a row of numbers per place (cut points) or per output (weights). NaN stays NaN."""

    kind = Param(Params._dummy(), "kind", "project, quantile or bin", TypeConverters.toString)
    table = Param(Params._dummy(), "table", "rows of numbers as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, kind: str = "bin", table: str = "[]") -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kind, entries = self.getOrDefault(self.kind), vector_to_array(self.getInputCol())
        rows = F.from_json(F.lit(self.getOrDefault(self.table)), "ARRAY<ARRAY<DOUBLE>>")
        if kind == "project":
            out = F.transform(rows, lambda weights: F.aggregate(F.zip_with(weights, entries, lambda w, x: w * x), F.lit(0.0), lambda total, x: total + x))
        elif kind == "bin":
            out = F.transform(entries, lambda x, k: F.when(F.isnan(x), x).otherwise(F.size(F.filter(F.get(rows, k), lambda c: c <= x)).cast("double")))
        else:
            def share(x: Column, k: Column) -> Column:
                cuts = F.get(rows, k)
                place = F.size(F.filter(cuts, lambda c: c < x)) / F.greatest(F.size(cuts) - 1, F.lit(1))
                return F.when(F.isnan(x), x).otherwise(F.least(place, F.lit(1.0)))

            out = F.transform(entries, share)
        return dataset.withColumn(self.getOutputCol(), array_to_vector(out))


class CommonValues(HasInputCols, HasOutputCols, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Values that are common stay, all others become one."""

    table = Param(Params._dummy(), "table", "the common values of each column as JSON", TypeConverters.toString)
    other = Param(Params._dummy(), "other", "what the others become", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, outputCols: Sequence[str] | None = None, table: str = "[]", other: str = "other") -> None:
        super().__init__()
        self._setDefault(other="other")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        tables, other = json.loads(self.getOrDefault(self.table)), F.lit(self.getOrDefault(self.other))
        made = {}
        for col, out, values in zip(self.getInputCols(), self.getOutputCols(), tables, strict=True):
            text = F.col(col).cast("string")
            made[out] = F.when(text.isin(values), text).otherwise(other)
        return dataset.withColumns(made)


class MinorityCoalescer(HasInputCols, HasOutputCols, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Finds the values with a share of at least `share` of the rows: at most 1 / share per column."""

    share = Param(Params._dummy(), "share", "least share of a common value", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, outputCols: Sequence[str] | None = None, share: float = 0.01) -> None:
        super().__init__()
        self._setDefault(share=0.01)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> CommonValues:
        least = self.getOrDefault(self.share) * dataset.count()
        tables = []
        for col in self.getInputCols():
            counts = dataset.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("v")).agg(F.count("*").alias("n"))
            tables.append([r["v"] for r in counts.where(F.col("n") >= least).orderBy("v").collect()])
        return CommonValues(inputCols=self.getInputCols(), outputCols=self.getOutputCols(), table=json.dumps(tables))


class MultinomialNB(C.NaiveBayes):
    """Spark's fit of the multinomial Naive Bayes, rated as the linear function that it is.

    A row with a smaller value than all rows of the fit is negative once it is scaled; Spark's own model ends the job there.
    The rows of the fit must not be negative.
    """

    def _create_model(self, java_model) -> LinearPosterior:
        fitted = super()._create_model(java_model)
        return LinearPosterior(table=json.dumps(np.column_stack([fitted.pi.toArray(), fitted.theta.toArray()]).tolist()))


class LinearPosterior(HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasThresholds, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Classes rated by a start and a weight per feature; their exponentials, as shares, are the probabilities."""

    table = Param(Params._dummy(), "table", "a row per class as JSON, its start first", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, table: str = "[]") -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n = len(json.loads(self.getOrDefault(self.table)))
        rows, x = F.from_json(F.lit(self.getOrDefault(self.table)), "ARRAY<ARRAY<DOUBLE>>"), vector_to_array(self.getFeaturesCol())
        says = F.raise_error(F.lit("Naive Bayes has no probabilities for a row with missing values")).cast("array<double>")
        whole = F.when(F.exists(x, F.isnan), says).otherwise(x)

        def rated(row: Column) -> Column:
            parts = F.zip_with(F.slice(row, 2, F.size(row) - 1), whole, lambda w, v: F.when(v != 0, w * v).otherwise(0.0))
            return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part) + F.get(row, F.lit(0))

        def shares(raw: Column) -> Column:
            odds = F.transform(raw, lambda r: F.exp(r - F.array_max(raw)))
            return F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda total, each: total + each))

        raw, probability = self.getRawPredictionCol(), self.getProbabilityCol()
        out = dataset.withColumn(raw, array_to_vector(F.transform(rows, rated)).alias(raw, metadata={"ml_attr": {"num_attrs": n}}))
        out = out.withColumn(probability, array_to_vector(shares(vector_to_array(raw))).alias(probability, metadata={"ml_attr": {"num_attrs": n}}))
        decides = vector_to_array(probability)
        if self.isSet(self.thresholds):
            least = F.lit([float(t) for t in self.getThresholds()])
            decides = F.zip_with(decides, least, lambda p, t: F.when(t == 0, float("inf")).otherwise(p / t))
        first = (F.array_position(decides, F.array_max(decides)) - 1).cast("double")
        named = self.getPredictionCol()
        return out.withColumn(named, first.alias(named, metadata={"ml_attr": {"type": "nominal", "num_vals": n}}))


def singular_vectors(df: DataFrame, n_features: int, k: int, features: str) -> tuple[np.ndarray, np.ndarray]:
    """The first k right singular vectors as columns, and their singular values.

    They are the eigenvectors of the matrix of column products, which is summed in one pass; only that
    (columns x columns) matrix is collected. The largest entry of a vector is positive.
    """
    arr = vector_to_array(features)
    x = [F.get(arr, F.lit(i)) for i in range(n_features)]
    pairs = [(i, j) for i in range(n_features) for j in range(i, n_features)]
    sums = df.agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((n_features, n_features))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:k]
    v = vectors[:, order]
    v = v * np.where(v[np.abs(v).argmax(0), range(v.shape[1])] < 0, -1.0, 1.0)
    return v, np.sqrt(np.maximum(values[order], 0.0))
