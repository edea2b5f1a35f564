"""Racing rounds and search-tree statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneloom.operators import racing as B
from tuneloom.operators import runs as R
from tuneloom.operators import tree as T
from tuneloom.plans.history import CANDIDATES_SQL, r6
from tuneloom.plans.registry import query
from tuneloom.sources import views as V

ETA, MIN_BUDGET, MAX_BUDGET = 3, 1, 27
K_MAX = B.most_candidates(ETA, MIN_BUDGET, MAX_BUDGET)

SCHED = """
sched AS (SELECT iteration, CAST(rung AS INTEGER) AS rung, CAST(greatest(floor(floor(floor(4e0 / (s + 1)) * pow(3e0, s)) * pow(3e0, -rung)), 1) AS INTEGER) AS n_candidates,
                 27e0 * pow(3e0, -(s - rung)) AS budget, rung = s AS last_rung
          FROM (SELECT iteration, s, unnest(generate_series(0, s)) AS rung FROM (SELECT DISTINCT iteration, 3 - iteration % 4 AS s FROM structures)))"""
RACERS = CANDIDATES_SQL + """,
racers AS (SELECT iteration, structure, rung, pow(3e0, rung) AS budget, loss,
                  CASE WHEN iteration < 2 THEN 'REVIEW' ELSE status END AS status FROM cand),
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY r.iteration, r.rung ORDER BY loss, structure) - 1 AS rk, n.n_candidates AS k
           FROM racers r LEFT JOIN sched n ON n.iteration = r.iteration AND n.rung = r.rung + 1),
prog AS (SELECT iteration, rung, count(*) AS n, CAST(sum(CASE WHEN status = 'RUNNING' THEN floor(r.budget) ELSE 0 END) AS BIGINT) AS n_running,
                any_value(n_candidates) AS n_candidates,
                count(*) >= any_value(n_candidates) AND count(*) FILTER (WHERE status IN ('RUNNING', 'QUEUED')) = 0 AS complete
         FROM racers r JOIN sched s USING (iteration, rung) GROUP BY iteration, rung)"""


def _schedule(spark, d):
    its = V.structures(spark, d).select("iteration").distinct()
    return B.hyperband_schedule(its, ETA, MIN_BUDGET, MAX_BUDGET)


def _racers(spark, d):
    cand = R.candidate_states(V.structures(spark, d), V.runs(spark, d))
    status = F.when(F.col("iteration") < 2, "REVIEW").otherwise(F.col("status"))
    return cand.select("iteration", "structure", "rung", F.pow(F.lit(3.0), "rung").alias("budget"), "loss", status.alias("status"))


@query("hyperband_schedule", f"""
    WITH {SCHED}, obs AS (SELECT iteration, rung, count(*) AS observed FROM structures GROUP BY ALL)
    SELECT iteration, rung, n_candidates, round(sched.budget, 6) AS budget, last_rung, coalesce(observed, 0) AS observed
    FROM sched LEFT JOIN obs USING (iteration, rung)""")
def hyperband_schedule(spark, d):
    observed = V.structures(spark, d).groupBy("iteration", "rung").agg(F.count("*").alias("observed"))
    return _schedule(spark, d).join(observed, ["iteration", "rung"], "left").select(
        "iteration", "rung", "n_candidates", r6("budget"), "last_rung", F.coalesce("observed", F.lit(0)).alias("observed"))


@query("successive_halving", f"""
    WITH {SCHED}, {RACERS} SELECT iteration, structure, rung, round(loss, 6) AS loss, coalesce(rk < k, false) AS advance FROM ranked""")
def successive_halving(spark, d):
    return B.successive_halving(_racers(spark, d), _schedule(spark, d), K_MAX).select(
        "iteration", "structure", "rung", r6("loss"), "advance")


@query("successive_resampling", f"""
    WITH {SCHED}, {RACERS}
    SELECT iteration, structure, rung, round(loss, 6) AS loss, k IS NOT NULL AND rk < greatest(1, k * 0.5e0) AS advance FROM ranked""")
def successive_resampling(spark, d):
    return B.successive_resampling(_racers(spark, d), _schedule(spark, d), K_MAX).select(
        "iteration", "structure", "rung", r6("loss"), "advance")


@query("iteration_progress", f"WITH {SCHED}, {RACERS} SELECT iteration, rung, n, n_running, n_candidates, complete FROM prog")
def iteration_progress(spark, d):
    return B.iteration_progress(_racers(spark, d), _schedule(spark, d))


@query("race_round", f"""
    WITH {SCHED}, {RACERS},
    rev AS (SELECT iteration, rung, structure, row_number() OVER (PARTITION BY iteration, rung ORDER BY loss, structure) - 1 AS rk
            FROM racers WHERE status = 'REVIEW'),
    m AS (SELECT r.*, coalesce(p.complete, false) AS done, coalesce(s.last_rung, false) AS fin, n.budget AS nb,
                 coalesce(p.complete AND NOT s.last_rung AND v.rk < n.n_candidates, false) AS moved
          FROM racers r LEFT JOIN prog p USING (iteration, rung) LEFT JOIN sched s USING (iteration, rung)
          LEFT JOIN sched n ON n.iteration = r.iteration AND n.rung = r.rung + 1
          LEFT JOIN rev v ON v.iteration = r.iteration AND v.rung = r.rung AND v.structure = r.structure)
    SELECT iteration, structure, round(loss, 6) AS loss,
           CASE WHEN done AND fin THEN 'COMPLETED' WHEN moved THEN 'QUEUED' WHEN done AND status = 'REVIEW' THEN 'TERMINATED' ELSE status END AS status,
           CASE WHEN moved THEN rung + 1 ELSE rung END AS rung, CASE WHEN moved THEN round(nb, 6) ELSE round(budget, 6) END AS budget
    FROM m""")
def race_round(spark, d):
    return B.race_round(_racers(spark, d), _schedule(spark, d), K_MAX).select(
        "iteration", "structure", r6("loss"), "status", "rung", r6("budget"))


@query("constant_budget", """
    SELECT iteration, structure, CAST(unnest(generate_series(1, 5)) AS INTEGER) AS config_no FROM structures""")
def constant_budget(spark, d):
    return B.constant_budget(V.structures(spark, d))


# ---- tree

CATALOGUE = ("click", "error", "purchase", "signup", "view")
CLASSIFIERS = ("purchase",)
FAILING = ("error",)

NODES = """
pre AS (SELECT array_to_string(steps[1:i], '/') AS path, i AS depth, reward
        FROM (SELECT steps, reward, CAST(unnest(range(len(steps) + 1)) AS INTEGER) AS i FROM chains)),
nodes AS (SELECT path, depth, count(*) AS visits, sum(reward) AS reward,
                 string_split(path, '/')[-1] = 'purchase' AS terminal, string_split(path, '/')[-1] = 'error' AS failed,
                 CASE WHEN depth = 0 THEN NULL ELSE array_to_string(string_split(path, '/')[1:depth - 1], '/') END AS parent
          FROM pre GROUP BY path, depth),
uct AS (SELECT n.path, n.parent, n.depth, n.visits,
               CASE WHEN n.failed THEN 0 ELSE n.reward / n.visits END AS exploit,
               CASE WHEN n.failed THEN 0 WHEN p.visits IS NULL THEN 0 ELSE -sqrt(ln(p.visits) / n.visits) END AS explore,
               1 - pow(2e0, n.depth) / 16e0 AS overfit
        FROM nodes n LEFT JOIN nodes p ON n.parent = p.path),
scored AS (SELECT *, (exploit + explore) * overfit AS score FROM uct)"""


def _nodes(spark, d):
    return T.mark_nodes(T.node_statistics(V.pipelines(spark, d)), CLASSIFIERS, FAILING)


@query("node_statistics", f"WITH {NODES} SELECT path, depth, visits, round(reward, 6) AS reward FROM nodes")
def node_statistics(spark, d):
    return T.node_statistics(V.pipelines(spark, d)).select("path", "depth", "visits", r6("reward"))


@query("node_statistics_direct", """
    WITH h AS (SELECT steps, reward, CAST(unnest([len(steps), len(steps) - 1, 0]) AS INTEGER) AS depth FROM chains)
    SELECT array_to_string(steps[1:depth], '/') AS path, depth, count(*) AS visits, round(sum(reward), 6) AS reward FROM h GROUP BY 1, 2""")
def node_statistics_direct(spark, d):
    return T.node_statistics(V.pipelines(spark, d), mode="reference").select("path", "depth", "visits", r6("reward"))


@query("visited_terminals", f"WITH {NODES} SELECT path, visits FROM nodes WHERE terminal AND NOT failed")
def visited_terminals(spark, d):
    return T.visited_terminals(_nodes(spark, d)).select("path", "visits")


@query("uct_score", f"""
    WITH {NODES} SELECT path, depth, visits, round(exploit, 12) AS exploit, round(explore, 6) AS explore, round(overfit, 6) AS overfit,
    round(score, 6) + 0e0 AS score FROM scored""")
def uct_score(spark, d):
    return T.uct_score(_nodes(spark, d)).select(
        "path", "depth", "visits", r6("exploit", digits=12), r6("explore"), r6("overfit"), r6("score"))


@query("best_child", f"""
    WITH {NODES} SELECT parent, arg_min(path, (round(score, 9) + 0e0, path)) AS child, round(min(score), 6) + 0e0 AS score
    FROM scored WHERE parent IS NOT NULL GROUP BY parent""")
def best_child(spark, d):
    scored = T.uct_score(_nodes(spark, d)).withColumn("score", F.round("score", 9) + 0.0)
    return T.best_child(scored).select("parent", "child", r6("score"))


@query("widening_limit", f"""
    WITH {NODES}, c AS (SELECT parent AS path, count(*) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
    w AS (SELECT n.path, visits, coalesce(children, 0) AS children, CAST(least(floor(pow(visits, 0.7e0)), 5, 7) AS INTEGER) AS lim
          FROM nodes n LEFT JOIN c ON c.path = n.path)
    SELECT path, visits, children, lim AS "limit", children <> 0 AND children >= lim AS "full" FROM w""")
def widening_limit(spark, d):
    return T.widening_limit(_nodes(spark, d), len(CATALOGUE))


@query("exploration_weight", """
    WITH t AS (SELECT config, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM runs)) / 1e6 AS el FROM runs),
    h AS (SELECT max(el) AS lim FROM t)
    SELECT config, round(greatest(0.1e0, (exp((lim - el) / lim) - 1) / (exp(1e0) - 1)), 6) AS weight FROM t, h""")
def exploration_weight(spark, d):
    us = V.runs(spark, d).select("config", F.unix_micros("ts").alias("us"))
    start, stop = us.agg(F.min("us")).scalar(), us.agg(F.max("us")).scalar()
    weight = T.exploration_weight((F.col("us") - start) / 1e6, (stop - start) / 1e6)
    return us.select("config", r6(weight, "weight"))


REMAIN = """
acts AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS action),
rem AS (SELECT n.path, a.action, n.depth, n.visits FROM nodes n, acts a
        WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent = n.path AND string_split(c.path, '/')[-1] = a.action))"""


@query("remaining_actions", f"WITH {NODES}, {REMAIN} SELECT path, action FROM rem")
def remaining_actions(spark, d):
    return T.remaining_actions(_nodes(spark, d), CATALOGUE)


ACTIONS = REMAIN + """,
kids AS (SELECT parent AS path, count(*) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
offer AS (SELECT path, bool_or(action = 'purchase') AS has_c FROM rem GROUP BY path),
prior AS (SELECT r.*, (CAST('0x' || substr(md5('9|' || r.path || '|' || r.action), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS perf FROM rem r),
act AS (SELECT p.path, action, perf, (-perf - sqrt(ln(greatest(visits, 1)))) * (1 - pow(2e0, depth + 1) / 16) AS score
        FROM prior p JOIN offer o ON o.path = p.path LEFT JOIN kids k ON k.path = p.path
        WHERE coalesce(children, 0) >= 2 OR NOT has_c OR action = 'purchase')"""


def _actions(spark, d):
    nodes = _nodes(spark, d)
    return T.action_scores(nodes, T.remaining_actions(nodes, CATALOGUE), CLASSIFIERS, seed=9)


@query("action_scores", f"WITH {NODES}, {ACTIONS} SELECT path, action, round(perf, 6) AS performance, round(score, 6) + 0e0 AS score FROM act")
def action_scores(spark, d):
    return _actions(spark, d).select("path", "action", r6("performance"), r6(F.col("score") + 0.0, "score"))


@query("best_action", f"""
    WITH {NODES}, {ACTIONS} SELECT path, arg_min(action, (round(score, 9) + 0e0, action)) AS action, round(min(score), 6) + 0e0 AS score FROM act GROUP BY path""")
def best_action(spark, d):
    rounded = _actions(spark, d).withColumn("score", F.round("score", 9) + 0.0)
    return T.best_action(rounded).select("path", "action", r6("score"))


@query("terminal_sampling", f"""
    WITH {NODES},
    tw AS (SELECT path, -reward / visits AS w FROM nodes WHERE terminal AND NOT failed AND reward < 0),
    cu AS (SELECT path, coalesce(sum(w) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT sum(w) FROM tw) AS at FROM tw),
    el AS (SELECT config, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM runs)) / CAST((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM runs) AS DOUBLE) / 2 AS chance FROM runs),
    rq AS (SELECT config, chance,
                  (CAST('0x' || substr(md5('1c|' || config), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS c,
                  (CAST('0x' || substr(md5('1|' || config), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u FROM el)
    SELECT config, CASE WHEN c < chance THEN path END AS path FROM rq ASOF LEFT JOIN cu ON rq.u >= cu.at""")
def terminal_sampling(spark, d):
    us = V.runs(spark, d).select("config", F.unix_micros("ts").alias("us"))
    start, stop = us.agg(F.min("us")).scalar(), us.agg(F.max("us")).scalar()
    requests = us.withColumn("chance", (F.col("us") - start) / (stop - start) / 2)
    return T.terminal_sampling(T.visited_terminals(_nodes(spark, d)), requests, "config", F.col("chance"), seed=1)


@query("search_hierarchy", f"""
    WITH {NODES}, c AS (SELECT parent AS path, string_agg(path, ',' ORDER BY path) AS children FROM scored WHERE parent IS NOT NULL GROUP BY parent)
    SELECT s.path, CASE WHEN s.path = '' THEN 'ROOT' ELSE string_split(s.path, '/')[-1] END AS label, depth, visits,
           round(score, 6) + 0e0 AS score, coalesce(children, '') AS children
    FROM scored s LEFT JOIN c ON c.path = s.path""")
def search_hierarchy(spark, d):
    docs = T.search_hierarchy(T.uct_score(_nodes(spark, d)))
    return docs.select("path", "label", "depth", "visits", r6(F.col("score") + 0.0, "score"), F.array_join("children", ",").alias("children"))


@query("path_runtime", """
    WITH st AS (SELECT steps, times, unnest(range(1, len(steps) + 1)) AS i FROM chains),
    own AS (SELECT array_to_string(steps[1:i], '/') AS path, i, avg(times[i]) AS t FROM st GROUP BY 1, 2),
    up AS (SELECT o.path, o.t, array_to_string(string_split(o.path, '/')[1:j], '/') AS above FROM (SELECT path, t, unnest(range(1, i + 1)) AS j FROM own) o)
    SELECT u.path, round(any_value(u.t), 9) AS own_time, round(sum(a.t), 9) AS path_time FROM up u JOIN own a ON a.path = u.above GROUP BY u.path""")
def path_runtime(spark, d):
    return T.path_runtime(V.pipelines(spark, d)).select("path", r6("own_time", digits=9), r6("path_time", digits=9))
