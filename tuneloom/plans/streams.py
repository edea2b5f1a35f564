"""Streams over the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneloom.plans.history import r6
from tuneloom.plans.registry import query
from tuneloom.streaming import runs as S


@query("stream_incumbent", """
    SELECT iteration, structure, arg_min(config, (loss, config)) AS config, round(min(loss), 6) AS loss FROM runs GROUP BY iteration, structure""")
def stream_incumbent(spark, d):
    return S.stream_incumbent(S.run_stream(spark, d)).select("iteration", "structure", "config", r6("loss"))


@query("stream_status_counts", """
    SELECT epoch_us(date_trunc('day', ts)) AS start_us, status, count(*) AS n, round(sum(training_time), 6) AS training_time
    FROM runs GROUP BY ALL
    HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM runs) - INTERVAL 1 HOUR""")
def stream_status_counts(spark, d):
    out = S.stream_status_counts(S.run_stream(spark, d))
    return out.select(F.unix_micros("start").alias("start_us"), "status", "n", r6("training_time"))


@query("stream_activity_sessions", """
    WITH g AS (SELECT structure, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY structure ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM runs),
    s AS (SELECT structure, ts, sum(fresh) OVER (PARTITION BY structure ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
    SELECT structure, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, count(*) AS n
    FROM s GROUP BY structure, no
    HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM runs) - INTERVAL 1 HOUR""")
def stream_activity_sessions(spark, d):
    out = S.stream_activity_sessions(S.run_stream(spark, d))
    return out.select("structure", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_dedup_structures", "SELECT DISTINCT iteration, structure FROM runs")
def stream_dedup_structures(spark, d):
    return S.stream_dedup_structures(S.run_stream(spark, d))
