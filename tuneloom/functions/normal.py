"""Normal distribution as column expressions (Spark has no erf).

Published approximations: Abramowitz and Stegun 7.1.26 for the error function
(absolute error below 1.5e-7) and Acklam's rational form for the quantile
(relative error below 1.2e-9).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the two published approximations.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
Q_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
Q_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
Q_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
Q_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
Q_LOW = 0.02425


def _poly(coefs, x: Column) -> Column:
    acc = F.lit(float(coefs[0]))
    for c in coefs[1:]:
        acc = acc * x + F.lit(float(c))
    return acc


def upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0."""
    x = z / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * x)
    return 0.5 * _poly(tuple(reversed(ERF_A)), t) * t * F.exp(-x * x)


def cdf(z: Column) -> Column:
    tail = upper_tail(F.abs(z))
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def density(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)


def add_quantile(df: DataFrame, p: str, name: str) -> DataFrame:
    """Adds the standard normal quantile of column `p`.

    Done in steps so that no intermediate value is written out more than once
    in the plan.
    """
    staged = df.withColumn("_m", F.col(p) - 0.5).withColumn("_s", F.col("_m") * F.col("_m")).withColumn(
        "_r", F.sqrt(-2.0 * F.log(F.least(F.col(p), 1 - F.col(p)))))
    s, r = F.col("_s"), F.col("_r")
    edge = _poly(Q_C, r) / (_poly(Q_D, r) * r + 1.0)
    middle = _poly(Q_A, s) * F.col("_m") / (_poly(Q_B, s) * s + 1.0)
    value = F.when(F.col(p) < Q_LOW, edge).when(F.col(p) > 1 - Q_LOW, -edge).otherwise(middle)
    return staged.withColumn(name, value).drop("_m", "_s", "_r")


def add_truncated(df: DataFrame, name: str, u: Column, mean: Column, scale: Column, lower: float, upper: float) -> DataFrame:
    """Adds the u-quantile, u in (0, 1), of a normal limited to [lower, upper]."""
    staged = df.withColumn("_lo", (F.lit(lower) - mean) / scale).withColumn("_hi", (F.lit(upper) - mean) / scale)
    staged = staged.withColumn("_lo", cdf(F.col("_lo"))).withColumn("_hi", cdf(F.col("_hi")))
    staged = add_quantile(staged.withColumn("_p", F.col("_lo") + u * (F.col("_hi") - F.col("_lo"))), "_p", "_z")
    value = F.greatest(F.lit(lower), F.least(F.lit(upper), mean + scale * F.col("_z")))
    return staged.withColumn(name, value).drop("_lo", "_hi", "_p", "_z")
