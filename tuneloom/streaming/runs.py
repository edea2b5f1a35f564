"""The run log as a stream.

Every query runs until the files present are read (`availableNow`); on a live
log the same definitions run with any other trigger. Results go to tables in
the shared folder, so a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneloom.session import new_path
from tuneloom.sources import views as V


def run_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Result lines as they arrive; zone-less timestamps are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return V.run_columns(spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder))


def to_table(stream: DataFrame, label: str) -> DataFrame:
    """Runs an append-mode query to the end of its input and reads its table."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    job = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def stream_incumbent(stream: DataFrame) -> DataFrame:
    """Best result so far per structure; every batch writes the structures it changed."""
    spark = stream.sparkSession
    path = new_path(spark, "incumbent")
    best = stream.groupBy("iteration", "structure").agg(F.min(F.struct("loss", "config")).alias("b")).select(
        "iteration", "structure", "b.loss", "b.config")

    def keep(batch: DataFrame, number: int) -> None:
        # a repeated batch overwrites its own folder
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/table/part={number}")

    job = (
        best.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    job.awaitTermination()
    written = T.StructType([*best.schema.fields, T.StructField("batch", T.IntegerType())])
    versions = spark.read.schema(written).parquet(f"{path}/table/*")
    latest = F.max_by(F.struct("loss", "config"), "batch")
    return versions.groupBy("iteration", "structure").agg(latest.alias("b")).select("iteration", "structure", "b.loss", "b.config")


def stream_status_counts(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Runs per status and tumbling window; a window is final once the watermark has passed it."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "status").agg(
        F.count("*").alias("n"), F.sum("training_time").alias("training_time"))
    return to_table(counts.select(F.col("w.start").alias("start"), "status", "n", "training_time"), "status")


def stream_activity_sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Bursts of runs per structure."""
    bursts = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "structure").agg(F.count("*").alias("n"))
    return to_table(bursts.select("structure", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"), "sessions")


def stream_dedup_structures(stream: DataFrame) -> DataFrame:
    """Every structure id once, however late it comes again; the state holds one entry per id."""
    once = stream.select("iteration", "structure").dropDuplicates(["iteration", "structure"])
    return to_table(once, "structures")
