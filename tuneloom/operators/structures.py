"""Structure analysis over steps in long form (chain, pos, step).

A chain has a bounded number of steps, so windows over a chain are small; all
counts are map-side combined before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.functions import names


def length_stats(steps: DataFrame, start: int = 0) -> DataFrame:
    """Mean and population deviation of the chain length after `start` steps."""
    lengths = steps.groupBy("chain").agg((F.count("*") - start).alias("n"))
    return lengths.agg(F.avg("n").alias("mean_length"), F.stddev_pop("n").alias("std_length"), F.count("*").alias("n_chains"))


def step_frequency(steps: DataFrame, start: int = 0, light: float = 0.01) -> DataFrame:
    """Share of each step among all steps; `light` marks rare ones."""
    used = steps.where(F.col("pos") >= start)
    counts = used.groupBy("step").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    weight = F.col("n") / total
    return counts.select("step", "n", weight.alias("weight"), (weight < light).alias("light"))


def edges(steps: DataFrame, start: int = 0) -> DataFrame:
    follow = F.lead("step").over(Window.partitionBy("chain").orderBy("pos"))
    used = steps.where(F.col("pos") >= start)
    return used.select("chain", F.col("step").alias("src"), follow.alias("dst"))


def edge_frequency(steps: DataFrame, per: str = "edges", start: int = 0) -> DataFrame:
    """Weight of each transition: its count over all chains, or over all transitions.

    With `per='edges'` a chain with a single step left adds one to the total.
    """
    pairs = edges(steps, start)
    counted = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    if per == "chains":
        total = steps.agg(F.count_if(F.col("pos") == 0)).scalar()  # every chain has one first step
    elif per == "edges":
        lengths = steps.groupBy("chain").agg((F.max("pos") + 1 - start).alias("left"))
        total = lengths.agg(F.sum(F.greatest(F.col("left") - 1, F.lit(0)) + (F.col("left") == 1).cast("int"))).scalar()
    else:
        raise ValueError("per must be 'edges' or 'chains'")
    return counted.where("dst IS NOT NULL").select("src", "dst", "n", (F.col("n") / total).alias("weight"))


def prefixed_steps(steps: DataFrame) -> DataFrame:
    """Long form with a common root and the position in the name."""
    named = steps.select("chain", (F.col("pos") + 1).alias("pos"), F.concat_ws("_", F.col("pos").cast("string"), "step").alias("step"))
    root = steps.where("pos = 0").select("chain", F.lit(0).alias("pos"), F.lit("__ROOT").alias("step"))
    return root.unionByName(named)


def node_in_weight(graph: DataFrame, light: float = 0.025) -> DataFrame:
    total = graph.groupBy(F.col("dst").alias("step")).agg(F.sum("weight").alias("weight"))
    return total.withColumn("light", F.col("weight") < light)


def prune_edges(graph: DataFrame, min_weight) -> DataFrame:
    return graph.where(F.col("weight") >= min_weight)


def flatten_pipelines(chains: DataFrame, branches: str = "branches") -> DataFrame:
    """One row per combination of branches."""
    return chains.withColumn("path", F.explode(names.flatten_branches(F.col(branches)))).drop(branches)
