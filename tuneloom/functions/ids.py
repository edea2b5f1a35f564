"""Candidate ids and model file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_candidate_id(text: Column) -> Column:
    """'01:02:03' -> (1, 2, 3); without a third part the config is NULL."""
    parts = F.split(text, ":")
    return F.struct(
        parts.getItem(0).cast("int").alias("iteration"),
        parts.getItem(1).cast("int").alias("structure"),
        F.when(F.size(parts) > 2, F.get(parts, F.lit(2)).cast("int")).alias("config"),
    )


def format_candidate_id(iteration: Column, structure: Column, config: Column) -> Column:
    short = F.format_string("%02d:%02d", iteration, structure)
    return F.when(config.isNull(), short).otherwise(F.format_string("%02d:%02d:%02d", iteration, structure, config))


def id_from_model_file(name: Column) -> Column:
    """The first three dash-separated numbers of a file name."""
    parts = F.split(F.regexp_extract(name, r"\d+-\d+-\d+", 0), "-")
    return F.struct(*[
        F.try_element_at(parts, F.lit(i + 1)).cast("int").alias(c)
        for i, c in enumerate(("iteration", "structure", "config"))
    ])


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def model_file_name(iteration: Column, structure: Column, config: Column, step: Column) -> Column:
    """File of a full candidate, or of a single step when `step` is not NULL."""
    full = F.format_string("models_%d-%d-%d.pkl", iteration, structure, config)
    return F.when(step.isNull(), full).otherwise(F.concat(F.lit("step_"), slug(step), F.lit(".pkl")))
