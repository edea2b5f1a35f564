"""Comparison of systems and scores over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneloom.functions import scores
from tuneloom.operators import compare as C
from tuneloom.operators import trajectory as T
from tuneloom.plans.history import r6
from tuneloom.plans.registry import query
from tuneloom.sources import views as V

IMPUTED = """
imp AS (SELECT task, system, fold, metric, coalesce(result, CASE WHEN metric = 'auc' THEN 0e0 ELSE 4e0 END) AS result FROM bench)"""
STATS = IMPUTED + """,
stats AS (SELECT task, system, avg(result) AS mean, coalesce(stddev_samp(result), 0) AS std, max(metric) AS metric,
                 count(*) FILTER (WHERE result IN (0, 4)) AS missing FROM imp GROUP BY task, system),
sgn AS (SELECT *, CASE WHEN metric = 'auc' THEN -mean ELSE mean END AS s FROM stats),
best AS (SELECT task, metric, arg_min(system, (s, system)) AS best_system, arg_min(mean, (s, system)) AS best_mean FROM sgn GROUP BY task, metric)"""


def _pairs(source: str) -> str:
    return f"""
pairs AS (SELECT o.task, o.system, o.fold, r.result AS ref, o.result
          FROM {source} o JOIN best b ON o.task = b.task AND o.system <> b.best_system
          JOIN {source} r ON r.task = o.task AND r.fold = o.fold AND r.system = b.best_system),
dd AS (SELECT task, system, round(ref - result, 9) AS d FROM pairs),
rk AS (SELECT *, rank() OVER (PARTITION BY task, system ORDER BY abs(d))
              + (count(*) OVER (PARTITION BY task, system, abs(d)) - 1) / 2.0e0 AS rnk FROM dd WHERE d <> 0),
tie AS (SELECT task, system, sum(t*t*t - t) AS ties FROM (SELECT task, system, abs(d), count(*) AS t FROM rk GROUP BY ALL) GROUP BY ALL),
ws AS (SELECT task, system, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rnk ELSE 0 END), sum(CASE WHEN d < 0 THEN rnk ELSE 0 END)) AS w FROM rk GROUP BY ALL),
al AS (SELECT task, system, count(*) AS n_pairs FROM pairs GROUP BY ALL),
ns AS (SELECT n, s, count(*) AS c FROM (SELECT n, k, list_sum([CASE WHEN (k >> i) & 1 = 1 THEN i + 1 ELSE 0 END FOR i IN range(n)]) AS s
       FROM (SELECT n, unnest(range(CAST(1 << n AS BIGINT))) AS k FROM (SELECT unnest(range(1, 11)) AS n))) GROUP BY ALL),
tests AS (SELECT task, system, coalesce(n, 0) AS n, coalesce(w, 0) AS w,
          CASE WHEN n IS NULL THEN NULL
               WHEN n = n_pairs AND ties = 0 THEN least(1e0, 2e0 * (SELECT sum(c) FROM ns WHERE ns.n = ws.n AND ns.s <= ws.w) / CAST(1 << n AS DOUBLE))
               ELSE least(1e0, 2e0 * (0.5e0 * t * (0.254829592e0 + t*(-0.284496736e0 + t*(1.421413741e0 + t*(-1.453152027e0 + t*1.061405429e0)))) * exp(-x*x))) END AS p
          FROM (SELECT *, 1e0 / (1e0 + 0.3275911e0 * x) AS t FROM (
                SELECT *, abs(w - n*(n+1)/4e0) / sqrt(n*(n+1)*(2*n+1)/24e0 - ties/48e0) / sqrt(2e0) AS x
                FROM al LEFT JOIN ws USING (task, system) LEFT JOIN tie USING (task, system))) ws)"""


def _imputed(spark, d):
    bench = V.bench(spark, d)
    return bench.withColumn("result", scores.impute_missing(F.col("result"), F.col("metric")))


@query("task_statistics", f"""
    WITH {STATS} SELECT task, system, round(mean, 9) AS mean, round(std, 9) AS std, metric, missing FROM stats""")
def task_statistics(spark, d):
    return C.task_statistics(_imputed(spark, d)).select(
        "task", "system", r6("mean", digits=9), r6("std", digits=9), "metric", "missing")


@query("rank_average", f"""
    WITH {IMPUTED}
    SELECT task, fold, system, rank() OVER (PARTITION BY task, fold ORDER BY s)
           + (count(*) OVER (PARTITION BY task, fold, s) - 1) / 2.0e0 AS rank
    FROM (SELECT *, CASE WHEN metric = 'auc' THEN -result ELSE result END AS s FROM imp)""")
def rank_average(spark, d):
    return C.rank_average(_imputed(spark, d), ["task", "fold"]).select("task", "fold", "system", "rank")


@query("average_rank", f"""
    WITH {STATS}
    SELECT metric, system, round(avg(r), 6) AS avg_rank, count(*) AS n_tasks
    FROM (SELECT metric, system, rank() OVER (PARTITION BY task ORDER BY s) + (count(*) OVER (PARTITION BY task, s) - 1) / 2.0e0 AS r
          FROM sgn WHERE task <> 'NATION_7') GROUP BY metric, system""")
def average_rank(spark, d):
    return C.average_rank(C.task_statistics(_imputed(spark, d)), exclude=["NATION_7"]).select(
        "metric", "system", r6("avg_rank"), "n_tasks")


@query("best_system", f"WITH {STATS} SELECT task, metric, best_system, round(best_mean, 9) AS best_mean FROM best")
def best_system(spark, d):
    return C.best_system(C.task_statistics(_imputed(spark, d))).select(
        "task", "metric", "best_system", r6("best_mean", digits=9))


@query("paired_results", f"""
    WITH {STATS}, {_pairs('imp')} SELECT task, system, fold, round(ref, 12) AS ref, round(result, 12) AS result FROM pairs""")
def paired_results(spark, d):
    rows = _imputed(spark, d)
    pairs = C.paired_results(rows, C.best_system(C.task_statistics(rows)))
    return pairs.select("task", "system", "fold", r6("ref", digits=12), r6("result", digits=12))


@query("wilcoxon", f"""
    WITH {STATS}, {_pairs('imp')}
    SELECT task, system, n, round(w, 6) AS statistic, round(p, 6) AS p_value, coalesce(p < 0.05, false) AS significant FROM tests""")
def wilcoxon(spark, d):
    rows = _imputed(spark, d)
    test = C.wilcoxon(C.paired_results(rows, C.best_system(C.task_statistics(rows))), "exact")
    return test.select("task", "system", "n", r6("statistic"), r6("p_value"), "significant")


@query("wilcoxon_exact", f"""
    WITH {STATS}, meas AS (SELECT * FROM bench WHERE result IS NOT NULL), {_pairs('meas')}
    SELECT task, system, n, round(w, 6) AS statistic, round(p, 6) AS p_value, coalesce(p < 0.05, false) AS significant FROM tests""")
def wilcoxon_exact(spark, d):
    """The same test on measured results only: no zero differences, so the exact distribution."""
    best = C.best_system(C.task_statistics(_imputed(spark, d)))
    test = C.wilcoxon(C.paired_results(V.bench(spark, d).where("result IS NOT NULL"), best), "exact")
    return test.select("task", "system", "n", r6("statistic"), r6("p_value"), "significant")


@query("comparison_table", f"""
    WITH {STATS}, {_pairs('imp')}
    SELECT s.task, s.metric, s.system, round(mean, 9) AS mean, round(std, 9) AS std,
           CASE WHEN mean IN (0, 4) THEN 'missing' WHEN mean = best_mean THEN 'best'
                WHEN NOT coalesce(p < 0.05, false) THEN 'same' ELSE 'worse' END AS flag
    FROM stats s JOIN best USING (task) LEFT JOIN tests t ON t.task = s.task AND t.system = s.system
    WHERE s.task <> 'NATION_7'""")
def comparison_table(spark, d):
    """The cells of the table, a row each, for all systems there are."""
    cells = C.comparison_cells(_imputed(spark, d), "exact", exclude=["NATION_7"])
    return cells.select("task", "metric", "system", r6("mean", digits=9), r6("std", digits=9), "flag")


RASTER = """
grid AS (SELECT system, sec FROM (SELECT DISTINCT system FROM traj), ticks),
ras AS (SELECT g.system, g.sec, coalesce(t.score, 0e0) AS score
        FROM grid g ASOF LEFT JOIN traj t ON g.system = t.system AND g.sec > t.sec)"""


def _raster(spark, d):
    points = V.traj(spark, d)
    return T.asof_raster(points, 3600, points.agg(F.max("sec")).scalar())


@query("asof_raster", f"WITH {RASTER} SELECT system, sec, round(score, 6) AS score FROM ras")
def asof_raster(spark, d):
    return _raster(spark, d).select("system", "sec", r6("score"))


@query("rank_over_time", f"""
    WITH {RASTER} SELECT system, sec, rank() OVER (PARTITION BY sec ORDER BY score)
         + (count(*) OVER (PARTITION BY sec, score) - 1) / 2.0e0 AS rank FROM ras""")
def rank_over_time(spark, d):
    return T.rank_over_time(_raster(spark, d)).select("system", "sec", "rank")


@query("best_so_far", """
    SELECT system, sec, round(max(score) OVER (PARTITION BY system ORDER BY sec), 6) AS best FROM traj""")
def best_so_far(spark, d):
    return T.best_so_far(V.traj(spark, d)).select("system", "sec", r6("best"))
