"""Splits and metrics over predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneloom.operators import metrics as M
from tuneloom.operators import splits
from tuneloom.plans.history import r6
from tuneloom.plans.registry import query
from tuneloom.sources import views as V

CLASS_SQL = """
cnt AS (SELECT c, sum(sup) AS sup, sum(pre) AS pre, sum(hit) AS hit FROM (
    SELECT y AS c, 1 AS sup, 0 AS pre, CAST(y = pred AS INTEGER) AS hit FROM preds_multi
    UNION ALL SELECT pred AS c, 0 AS sup, 1 AS pre, 0 AS hit FROM preds_multi) GROUP BY c)
"""


@query("holdout_split", """
    SELECT row_id, y, (CAST('0x' || substr(md5('42|' || CAST(row_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 < 0.2e0 AS is_test
    FROM preds_bin""")
def holdout_split(spark, d):
    return splits.holdout_split(V.preds_bin(spark, d).select("row_id", "y"), "row_id")


_ORDERED = """SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('{seed}|' || CAST(row_id AS VARCHAR)), row_id) - 1 AS rn,
              count(*) OVER (PARTITION BY y) AS n FROM preds_multi"""


@query("stratified_split", f"SELECT row_id, y, rn < round(n * 0.2e0) AS is_test FROM ({_ORDERED.format(seed=0)})")
def stratified_split(spark, d):
    return splits.stratified_split(V.preds_multi(spark, d).select("row_id", "y"), "y", "row_id")


@query("stratified_folds", f"SELECT row_id, y, CAST(rn % 4 AS INTEGER) AS fold FROM ({_ORDERED.format(seed=42)})")
def stratified_folds(spark, d):
    return splits.stratified_folds(V.preds_multi(spark, d).select("row_id", "y"), "y", "row_id")


@query("class_counts", "SELECT y AS label, count(*) AS n FROM preds_multi GROUP BY y")
def class_counts(spark, d):
    return splits.class_counts(V.preds_multi(spark, d), "y")


@query("accuracy", "SELECT round(avg(CAST(y = pred AS INTEGER)), 6) AS accuracy FROM preds_multi")
def accuracy(spark, d):
    return M.accuracy(V.preds_multi(spark, d)).select(r6("accuracy"))


@query("weighted_precision", f"""
    WITH {CLASS_SQL} SELECT round(sum(sup * CASE WHEN pre > 0 THEN hit / CAST(pre AS DOUBLE) ELSE 0 END) / sum(sup), 6) AS precision FROM cnt""")
def weighted_precision(spark, d):
    return M.weighted_precision(V.preds_multi(spark, d)).select(r6("precision"))


@query("weighted_recall", f"WITH {CLASS_SQL} SELECT round(sum(hit) / CAST(sum(sup) AS DOUBLE), 6) AS recall FROM cnt")
def weighted_recall(spark, d):
    return M.weighted_recall(V.preds_multi(spark, d)).select(r6("recall"))


@query("weighted_f1", f"WITH {CLASS_SQL} SELECT round(sum(sup * (2e0 * hit / (sup + pre))) / sum(sup), 6) AS f1 FROM cnt")
def weighted_f1(spark, d):
    return M.weighted_f1(V.preds_multi(spark, d)).select(r6("f1"))


@query("log_loss", """
    SELECT round(avg(-ln(greatest(1e-15, least(1 - 1e-15, CASE y WHEN 'A' THEN pa WHEN 'N' THEN pn ELSE pr END)))), 6) AS logloss
    FROM preds_multi""")
def log_loss(spark, d):
    return M.log_loss(V.preds_multi(spark, d), V.CLASSES).select(r6("logloss"))


AUC = """(sum(r) FILTER (hit) - {p} * ({p} + 1) / 2e0) / ({p} * CAST(count(*) FILTER (NOT hit) AS DOUBLE))"""


@query("roc_auc", f"""
    SELECT round({AUC.format(p='CAST(count(*) FILTER (hit) AS DOUBLE)')}, 6) AS roc_auc FROM (
        SELECT y = 1 AS hit, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r FROM preds_bin)""")
def roc_auc(spark, d):
    return M.roc_auc(V.preds_bin(spark, d)).select(r6("roc_auc"))


@query("roc_auc_ovr", f"""
    WITH l AS (SELECT 'A' AS c, y = 'A' AS hit, round(pa, 12) AS p FROM preds_multi UNION ALL SELECT 'N' AS c, y = 'N' AS hit, round(pn, 12) AS p FROM preds_multi
               UNION ALL SELECT 'R' AS c, y = 'R' AS hit, round(pr, 12) AS p FROM preds_multi),
    k AS (SELECT c, hit, rank() OVER (PARTITION BY c ORDER BY p) + (count(*) OVER (PARTITION BY c, p) - 1) / 2e0 AS r FROM l),
    a AS (SELECT c, {AUC.format(p='CAST(count(*) FILTER (hit) AS DOUBLE)')} AS auc, count(*) FILTER (hit) AS n FROM k GROUP BY c)
    SELECT round(sum(auc * n) / sum(n), 6) AS roc_auc FROM a""")
def roc_auc_ovr(spark, d):
    rows = V.preds_multi(spark, d).withColumn("probs", F.transform("probs", lambda p: F.round(p, 12)))
    return M.roc_auc_ovr(rows, V.CLASSES).select(r6("roc_auc"))
