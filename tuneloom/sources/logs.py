"""Run logs as JSON lines, and the nested history document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.functions import ids
from tuneloom.operators import skew

RESULT_SCHEMA = (
    "id STRING, status STRING, loss DOUBLE, structure_loss DOUBLE, "
    "runtime STRUCT<training_time: DOUBLE, timestamp: DOUBLE>, origin STRING, model_file STRING"
)
STRUCTURE_SCHEMA = "cid STRING, budget DOUBLE"
STEP_SCHEMA = "config ARRAY<DOUBLE>, configspace STRING, name STRING"


def result_lines(results: DataFrame) -> DataFrame:
    """One JSON line per result: a two-element array of id triple and result."""
    body = F.to_json(F.struct(
        "status", "loss", "structure_loss",
        F.struct("training_time", (F.unix_micros("ts") / 1e6).alias("timestamp")).alias("runtime"), "origin",
        ids.model_file_name(*(F.col(c).cast("int") for c in ("iteration", "structure", "config")), F.lit(None)).alias("model_file")))
    cid = F.concat_ws(",", F.col("iteration").cast("string"), F.col("structure").cast("string"), F.col("config").cast("string"))
    return results.select(F.concat(F.lit("[["), cid, F.lit("],"), body, F.lit("]")).alias("value"))


def structure_lines(structures: DataFrame) -> DataFrame:
    cid = F.format_string("%02d:%02d", F.col("iteration").cast("int"), F.col("structure").cast("int"))
    return structures.select(F.to_json(F.struct(cid.alias("cid"), F.col("budget").cast("double").alias("budget"))).alias("value"))


def parse_result_lines(lines: DataFrame) -> DataFrame:
    """Bad lines keep a NULL id, so they can be counted."""
    pair = F.from_json("value", "ARRAY<STRING>")
    parsed = lines.select(
        F.from_json(F.get(pair, F.lit(0)), "ARRAY<BIGINT>").alias("cid"),
        F.from_json(F.get(pair, F.lit(1)), RESULT_SCHEMA).alias("r"))
    return parsed.select(
        F.get("cid", F.lit(0)).cast("int").alias("iteration"), F.get("cid", F.lit(1)).alias("structure"),
        F.get("cid", F.lit(2)).alias("config"), "r.status", "r.loss", "r.structure_loss",
        F.col("r.runtime.training_time").alias("training_time"), F.col("r.runtime.timestamp").alias("timestamp"), "r.origin", "r.model_file")


def parse_structure_lines(lines: DataFrame) -> DataFrame:
    s = lines.select(F.from_json("value", STRUCTURE_SCHEMA).alias("s")).select("s.cid", "s.budget")
    parts = F.split("cid", ":")
    return s.select(
        parts.getItem(0).cast("int").alias("iteration"), parts.getItem(1).cast("bigint").alias("structure"), "budget")


def read_run_log(structure_text: DataFrame, result_text: DataFrame) -> DataFrame:
    """Results attached to their structures, both given as text lines."""
    return parse_result_lines(result_text).join(parse_structure_lines(structure_text), ["iteration", "structure"])


def read_run_log_files(spark: SparkSession, structure_path: str, result_path: str) -> DataFrame:
    return read_run_log(spark.read.text(structure_path), spark.read.text(result_path))


def write_log_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def append_structures(new: DataFrame, path: str) -> None:
    new.write.mode("append").partitionBy("iteration").parquet(path)


def append_results(marked: DataFrame, path: str, reject_path: str) -> None:
    """Accepted results go to the log, the others to a reject table."""
    marked.where("accepted").drop("accepted").write.mode("append").partitionBy("iteration").parquet(path)
    marked.where("NOT accepted").drop("accepted").write.mode("append").parquet(reject_path)


def step_lines(steps: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(F.array("quantity", "tax").alias("config"), F.concat(F.lit("step_"), F.col("step_no").cast("string")).alias("name")))
    name = F.concat(F.lit('"step_'), F.col("step_no").cast("string"), F.lit('"'))
    return steps.select("run_id", F.concat(F.lit("["), name, F.lit(","), body, F.lit(',"'), F.col("origin"), F.lit('"]')).alias("value"))


def read_step_log(lines: DataFrame) -> DataFrame:
    """Step configurations, one row per (run, step)."""
    triple = F.from_json("value", "ARRAY<STRING>")
    parsed = lines.select(
        "run_id", F.get(triple, F.lit(0)).alias("name"),
        F.from_json(F.get(triple, F.lit(1)), STEP_SCHEMA).alias("c"), F.get(triple, F.lit(2)).alias("origin"))
    return parsed.select("run_id", "name", F.col("c.config").alias("config"), "origin")


def export_history(structures: DataFrame, results: DataFrame, per_document: int, metric: str = "f1") -> DataFrame:
    """Nested documents: a structure with its configs.

    A document holds up to `per_document` configs; a structure with more is continued
    in further documents (`part`), so that no document grows with the data.
    """
    sign = 1.0 if metric == "logloss" else -1.0
    placed = skew.row_numbers(results, ["iteration", "structure"], ["ts", "config"], "pos")
    placed = placed.withColumn("part", F.floor(F.col("pos") / per_document).cast("long"))
    config = F.struct("pos", "config", "status", (F.col("loss") * sign).alias("loss"), "structure_loss", "origin", "training_time")
    docs = placed.groupBy("iteration", "structure", "part").agg(
        F.array_sort(F.collect_list(config)).alias("configs"), F.count("*").alias("n_configs"))
    joined = docs.join(structures, ["iteration", "structure"])
    cid = F.format_string("%02d:%02d", F.col("iteration"), F.col("structure"))
    return joined.select(
        "iteration", "structure", "part", "n_configs",
        F.to_json(F.struct(cid.alias("cid"), F.lit(metric).alias("metric"), "budget", "configs")).alias("document"))


def write_history(documents: DataFrame, path: str) -> None:
    """Fails when the path exists: a log is never overwritten."""
    documents.select("document").write.mode("errorifexists").text(path)
