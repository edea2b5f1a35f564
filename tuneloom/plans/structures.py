"""Structure graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneloom.functions import names
from tuneloom.operators import structures as S
from tuneloom.plans.history import r6
from tuneloom.plans.registry import query
from tuneloom.sources import views as V

# Component names standing in for the event types, as another tool would log them.
VENDOR = {
    "view": "NumericalImputation", "click": "StandardScalerComponent", "signup": "NoRescalingComponent",
    "error": "SelectPercentileClassification", "purchase": "RandomForest",
}
RENAMED_SQL = """
ren AS (SELECT chain, pos, CASE step WHEN 'view' THEN 'SimpleImputer' WHEN 'click' THEN 'StandardScaler'
               WHEN 'error' THEN 'SelectPercentile' ELSE 'RandomForestClassifier' END AS name,
               CASE step WHEN 'view' THEN 'Imputer' WHEN 'click' THEN 'Scaling'
               WHEN 'error' THEN 'Selection' ELSE 'Classifier' END AS category
        FROM chain_steps WHERE step <> 'signup')
"""


def _vendor_steps():
    return F.transform("steps", lambda s: F.try_element_at(names.lookup(VENDOR), s))


@query("rename_steps", f"""
    WITH {RENAMED_SQL}
    SELECT c.chain, coalesce(string_agg(name, '>' ORDER BY pos), '') AS steps
    FROM chains c LEFT JOIN ren USING (chain) GROUP BY c.chain""")
def rename_steps(spark, d):
    return V.pipelines(spark, d).select("chain", F.array_join(names.rename_steps(_vendor_steps()), ">").alias("steps"))


@query("coalesce_steps", f"""
    WITH {RENAMED_SQL}
    SELECT c.chain, coalesce(string_agg(category, '>' ORDER BY pos), '') AS steps
    FROM chains c LEFT JOIN ren USING (chain) GROUP BY c.chain""")
def coalesce_steps(spark, d):
    renamed = names.rename_steps(_vendor_steps())
    return V.pipelines(spark, d).select("chain", F.array_join(names.coalesce_steps(renamed), ">").alias("steps"))


@query("prefixed_names", """
    SELECT chain, '__ROOT>' || string_agg(CAST(pos AS VARCHAR) || '_' || step, '>' ORDER BY pos) AS steps
    FROM chain_steps GROUP BY chain""")
def prefixed_names(spark, d):
    return V.pipelines(spark, d).select("chain", F.array_join(names.prefixed_names(F.col("steps")), ">").alias("steps"))


@query("flatten_pipelines", """
    WITH RECURSIVE br(step, names) AS (VALUES ('view', 'OneHotEncoder'), ('view', 'SimpleImputer>StandardScaler'),
        ('click', 'click'), ('signup', 'signup'), ('error', 'error'), ('purchase', 'purchase')),
    walk AS (
        SELECT chain, pos, names AS path FROM chain_steps JOIN br USING (step) WHERE pos = 0
        UNION ALL
        SELECT w.chain, s.pos, w.path || '>' || br.names FROM walk w
        JOIN chain_steps s ON s.chain = w.chain AND s.pos = w.pos + 1 JOIN br ON br.step = s.step)
    SELECT w.chain, w.path FROM walk w JOIN chains c ON c.chain = w.chain AND w.pos = len(c.steps) - 1""")
def flatten_pipelines(spark, d):
    fork = F.lit([["OneHotEncoder"], ["SimpleImputer", "StandardScaler"]])
    branches = F.transform("steps", lambda s: F.when(s == "view", fork).otherwise(F.array(F.array(s))))
    flat = S.flatten_pipelines(V.pipelines(spark, d).select("chain", branches.alias("branches")))
    return flat.select("chain", F.array_join("path", ">").alias("path"))


@query("structure_length_stats", """
    SELECT round(avg(n), 6) AS mean_length, round(stddev_pop(n), 6) AS std_length, count(*) AS n_chains
    FROM (SELECT chain, count(*) - 1 AS n FROM chain_steps GROUP BY chain)""")
def structure_length_stats(spark, d):
    return S.length_stats(V.chain_steps(spark, d), start=1).select(r6("mean_length"), r6("std_length"), "n_chains")


@query("step_frequency", """
    SELECT step, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM chain_steps), 6) AS weight,
           count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM chain_steps) < 0.01 AS light
    FROM chain_steps GROUP BY step""")
def step_frequency(spark, d):
    return S.step_frequency(V.chain_steps(spark, d)).select("step", "n", r6("weight"), "light")


EDGES_SQL = """
    pairs AS (SELECT a.step AS src, b.step AS dst FROM chain_steps a JOIN chain_steps b ON a.chain = b.chain AND b.pos = a.pos + 1),
    tot AS (SELECT CAST(sum(CASE WHEN n = 1 THEN 1 ELSE n - 1 END) AS DOUBLE) AS t FROM (SELECT count(*) AS n FROM chain_steps GROUP BY chain)),
    ef AS (SELECT src, dst, count(*) AS n, count(*) / (SELECT t FROM tot) AS weight FROM pairs GROUP BY src, dst),
    pre AS (SELECT chain, pos + 1 AS pos, CAST(pos AS VARCHAR) || '_' || step AS step FROM chain_steps
            UNION ALL SELECT chain, 0 AS pos, '__ROOT' AS step FROM chain_steps WHERE pos = 0),
    nc AS (SELECT CAST(count(DISTINCT chain) AS DOUBLE) AS t FROM chain_steps),
    pf AS (SELECT a.step AS src, b.step AS dst, count(*) AS n, count(*) / (SELECT t FROM nc) AS weight
           FROM pre a JOIN pre b ON a.chain = b.chain AND b.pos = a.pos + 1 GROUP BY a.step, b.step)
"""


@query("edge_frequency", f"WITH {EDGES_SQL} SELECT src, dst, n, round(weight, 6) AS weight FROM ef")
def edge_frequency(spark, d):
    return S.edge_frequency(V.chain_steps(spark, d)).select("src", "dst", "n", r6("weight"))


@query("edge_frequency_prefixed", f"WITH {EDGES_SQL} SELECT src, dst, n, round(weight, 6) AS weight FROM pf")
def edge_frequency_prefixed(spark, d):
    steps = S.prefixed_steps(V.chain_steps(spark, d))
    return S.edge_frequency(steps, per="chains").select("src", "dst", "n", r6("weight"))


@query("node_in_weight", f"""
    WITH {EDGES_SQL} SELECT dst AS step, round(sum(weight), 6) AS weight, sum(weight) < 0.025 AS light FROM pf GROUP BY dst""")
def node_in_weight(spark, d):
    graph = S.edge_frequency(S.prefixed_steps(V.chain_steps(spark, d)), per="chains")
    return S.node_in_weight(graph).select("step", r6("weight"), "light")


@query("prune_edges", f"WITH {EDGES_SQL} SELECT src, dst, n, round(weight, 6) AS weight FROM pf WHERE n >= 3")
def prune_edges(spark, d):
    steps = S.prefixed_steps(V.chain_steps(spark, d))
    graph = S.edge_frequency(steps, per="chains")
    n_chains = V.chain_steps(spark, d).agg(F.count_if(F.col("pos") == 0)).scalar()
    return S.prune_edges(graph, F.lit(3.0) / n_chains).select("src", "dst", "n", r6("weight"))


@query("scale_weights", f"""
    WITH {EDGES_SQL} SELECT src, dst, round(0.85e0 * (weight - 0.01e0) / 0.24e0 + 0.15e0, 6) AS label FROM ef WHERE weight >= 0.01""")
def scale_weights(spark, d):
    graph = S.prune_edges(S.edge_frequency(V.chain_steps(spark, d)), 0.01)
    return graph.select("src", "dst", r6(names.scale_weight(F.col("weight")), "label"))
