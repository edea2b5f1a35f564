"""Statistics of the search tree, from finished chains.

A node is a path of steps, 'a/b/c'; the root is ''. Paths have at most as many
steps as a chain, so a chain yields a bounded number of nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.functions import draws
from tuneloom.operators import skew

# Widening exponent, most children, depth scale.
WIDENING = 0.7
MOST_CHILDREN = 7
DEPTH_SCALE = 16.0


def parent_path(path: Column) -> Column:
    """Path without its last step; NULL for the root."""
    parts = F.split(path, "/")
    return F.when(path == "", F.lit(None)).otherwise(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))


def last_step(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _prefix(i: Column) -> Column:
    return F.array_join(F.slice("steps", F.lit(1), i), "/")


def node_statistics(chains: DataFrame, mode: str = "all") -> DataFrame:
    """Visits and total reward per node.

    `all`: a chain counts once for each of its prefixes and the root.
    `reference`: for the node itself, its direct parent and the root, so the root
    counts twice when it is the parent.
    """
    n = F.size("steps")
    if mode == "all":
        which = F.sequence(F.lit(0), n)
    elif mode == "reference":
        which = F.array(n, n - 1, F.lit(0))
    else:
        raise ValueError("mode must be 'all' or 'reference'")
    hits = chains.select("steps", "reward", F.explode(which).alias("depth"))
    return hits.select(_prefix(F.col("depth")).alias("path"), "depth", "reward").groupBy("path", "depth").agg(
        F.count("*").alias("visits"), F.sum("reward").alias("reward"))


def mark_nodes(stats: DataFrame, classifiers: Sequence[str], failing: Sequence[str]) -> DataFrame:
    step = last_step(F.col("path"))
    return stats.withColumn("terminal", step.isin(*classifiers)).withColumn("failed", step.isin(*failing))


def visited_terminals(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("terminal") & ~F.col("failed") & (F.col("visits") > 0))


def depth_factor(depth: Column) -> Column:
    return 1 - F.pow(F.lit(2.0), depth) / DEPTH_SCALE


def uct_score(nodes: DataFrame, weight: float = 1.0, worst: float = 0.0) -> DataFrame:
    """Upper confidence bound per node with its parts; smaller is better."""
    parents = nodes.select(F.col("path").alias("parent"), F.col("visits").alias("parent_visits"))
    joined = nodes.withColumn("parent", parent_path(F.col("path"))).join(parents, "parent", "left")
    bad = F.col("failed") | (F.col("visits") == 0)
    log_n = F.when(F.coalesce("parent_visits", F.lit(0)) > 0, F.log(F.col("parent_visits").cast("double"))).otherwise(0.0)
    exploit = F.when(bad, worst).otherwise(F.col("reward") / F.col("visits"))
    explore = F.when(bad, worst).otherwise(-F.sqrt(log_n / F.col("visits")))
    overfit = depth_factor(F.col("depth"))
    return joined.select(
        "path", "parent", "depth", "visits", exploit.alias("exploit"), explore.alias("explore"),
        overfit.alias("overfit"), ((exploit + weight * explore) * overfit).alias("score"))


def best_child(scored: DataFrame) -> DataFrame:
    """Child with the smallest score per parent; the first path on ties."""
    return scored.where("parent IS NOT NULL").groupBy("parent").agg(
        F.min_by("path", F.struct("score", "path")).alias("child"), F.min("score").alias("score"))


def widening_limit(nodes: DataFrame, possible: int) -> DataFrame:
    """How many children a node may have, and whether it is full."""
    children = nodes.select(parent_path(F.col("path")).alias("path")).where("path IS NOT NULL").groupBy("path").agg(
        F.count("*").alias("children"))
    joined = nodes.join(children, "path", "left").fillna(0, subset=["children"])
    limit = F.least(F.floor(F.pow(F.col("visits").cast("double"), F.lit(WIDENING))), F.lit(possible), F.lit(MOST_CHILDREN))
    full = (F.lit(possible) == 0) | ((F.col("children") != 0) & (F.col("children") >= F.col("limit")))
    return joined.select("path", "visits", "children", limit.cast("int").alias("limit")).withColumn("full", full)


def exploration_weight(elapsed: Column, limit: Column, weight: float = 1.0) -> Column:
    decay = (F.exp((limit - elapsed) / limit) - 1.0) / (F.exp(F.lit(1.0)) - 1.0)
    return F.greatest(F.lit(0.1), weight * decay)


def remaining_actions(nodes: DataFrame, catalogue: Sequence[str]) -> DataFrame:
    """(path, action) pairs not tried yet; the catalogue is a short fixed list."""
    wanted = nodes.select("path", F.explode(F.lit(list(catalogue))).alias("action"))
    tried = nodes.where("path <> ''").select(parent_path(F.col("path")).alias("path"), last_step(F.col("path")).alias("action"))
    return wanted.join(tried, ["path", "action"], "left_anti")


def action_scores(nodes: DataFrame, remaining: DataFrame, classifiers: Sequence[str],
                  priors: DataFrame | None = None, seed: int = 0, weight: float = 1.0) -> DataFrame:
    """Score of every untried action, its expected performance taken as one visit.

    Without `priors` (path, action, performance) the expectation is a uniform draw.
    A node with fewer than two visited children tries classifiers first.
    """
    if priors is None:
        rated = remaining.withColumn("performance", draws.uniform(seed, "path", "action"))
    else:
        rated = remaining.join(priors, ["path", "action"])
    children = nodes.where("path <> ''").groupBy(parent_path(F.col("path")).alias("path")).agg(F.count("*").alias("children"))
    is_classifier = F.col("action").isin(*classifiers)
    offered = rated.groupBy("path").agg(F.max(is_classifier).alias("has_classifier"))
    joined = (
        rated.join(nodes.select("path", "depth", "visits"), "path")
        .join(children, "path", "left").join(offered, "path").fillna(0, subset=["children"]))
    kept = joined.where((F.col("children") >= 2) | ~F.col("has_classifier") | is_classifier)
    log_n = F.log(F.greatest(F.col("visits"), F.lit(1)).cast("double"))
    score = (-F.col("performance") - weight * F.sqrt(log_n)) * depth_factor(F.col("depth") + 1)
    return kept.select("path", "action", "performance", score.alias("score"))


def best_action(scored: DataFrame) -> DataFrame:
    return scored.groupBy("path").agg(F.min_by("action", F.struct("score", "action")).alias("action"), F.min("score").alias("score"))


def terminal_sampling(terminals: DataFrame, requests: DataFrame, key: str, chance: Column, seed: int = 0) -> DataFrame:
    """For every request, with probability `chance`, a terminal node drawn in proportion to -reward/visits.

    Nodes and requests are laid out on [0, 1); a request takes the node below it,
    found in one ordered pass instead of a range join.
    """
    weighted = terminals.select("path", (-F.col("reward") / F.col("visits")).alias("w")).where("w > 0").withColumn("_all", F.lit(0))
    total = weighted.agg(F.sum("w")).scalar()
    placed = skew.running(weighted, ["_all"], ["path"], {"before": ("sum_before", F.col("w"))})
    nodes = placed.select("_all", (F.col("before") / total).alias("at"), F.lit(0).alias("kind"), F.lit("").alias("req"), "path")
    asked = requests.where(draws.uniform(f"{seed}c", key) < chance).select(
        F.lit(0).alias("_all"), draws.uniform(seed, key).alias("at"), F.lit(1).alias("kind"),
        F.col(key).cast("string").alias("req"), F.lit(None).cast("string").alias("path"))
    seen = skew.running(nodes.unionByName(asked), ["_all"], ["at", "kind", "req"], {"node": ("last", F.col("path"))})
    picked = seen.where("kind = 1").select(F.col("req").alias("_req"), F.col("node").alias("path"))
    return requests.withColumn("_req", F.col(key).cast("string")).join(picked, "_req", "left").select(key, "path")


def search_hierarchy(scored: DataFrame) -> DataFrame:
    """One document per node with its scores and the list of its children.

    The documents refer to each other by path, so the tree never has to fit into
    one row; a node has at most as many children as there are components.
    """
    children = scored.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(
        F.array_sort(F.collect_list("path")).alias("children"))
    joined = scored.drop("parent").join(children, "path", "left")
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    return joined.select(
        "path", F.when(F.col("path") == "", "ROOT").otherwise(last_step(F.col("path"))).alias("label"),
        "depth", "visits", "exploit", "explore", "score", F.coalesce("children", none).alias("children"))


def path_runtime(chains: DataFrame) -> DataFrame:
    """Mean time of every node's own step and the time including all its ancestors."""
    hits = chains.select("steps", F.posexplode("times").alias("i", "time"))
    own = hits.select(_prefix(F.col("i") + 1).alias("path"), "time").groupBy("path").agg(F.avg("time").alias("own_time"))
    parts = F.split("path", "/")
    climb = own.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i"))
    above = climb.select("path", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("i")), "/").alias("above"))
    total = above.join(own.select(F.col("path").alias("above"), "own_time"), "above").groupBy("path").agg(
        F.sum("own_time").alias("path_time"))
    return own.join(total, "path")
