"""Structured Streaming jobs over arriving clips and pull logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_capture_blocks(clips: DataFrame, gap: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """station, start, end, n: live capture blocks, final once the watermark passes; a gap of exactly gap stays one block."""
    s = clips.withWatermark("ts", delay).groupBy("station", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("station", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_dedup(clips: DataFrame, key: str = "audio_hash", delay: str = "1 hour") -> DataFrame:
    """The first arrival of each hash within the watermark."""
    return clips.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def merge_pulls(table: str, key: str = "pull"):
    """A foreachBatch function that adds a batch's pulls to a Parquet log, each pull once.

    A batch is a folder of the log. If it runs again it writes its own folder anew, and
    pulls that another batch holds are left out, also after a restart with new batch ids.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates([key])
        if exists(batch.sparkSession, table):
            others = batch.sparkSession.read.parquet(table).where(F.col("batch") != batch_id).select(key)
            new = new.join(others, key, "left_anti")
        new.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return merge


def stream_posteriors(pulls: DataFrame, table: str, checkpoint: str) -> None:
    """Merges all pulls (pull, arm, successes, failures) that are there now into the log; log_posteriors() reads it."""
    pulls.writeStream.foreachBatch(merge_pulls(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def log_posteriors(spark: SparkSession, table: str) -> DataFrame:
    """Successes, failures and posterior mean per arm of a log of pulls."""
    n = spark.read.parquet(table).groupBy("arm").agg(F.sum("successes").alias("successes"), F.sum("failures").alias("failures"))
    return n.withColumn("mean", (F.col("successes") + 1) / (F.col("successes") + F.col("failures") + 2))


def stream_qc_tally(clips: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """start, reason, n by window; rows later than the watermark are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    t = clips.withWatermark("ts", delay).groupBy(w.alias("w"), "reason").agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.col("w.start").alias("start"), "reason", "n")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there now, and ends."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def exists(spark: SparkSession, table: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def append_once(df: DataFrame, table: str, key: str) -> int:
    """Appends rows whose key the Parquet table lacks; a redo of the same unit adds nothing. Returns how many."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    if exists(spark, table):
        new = new.join(spark.read.parquet(table).select(key), key, "left_anti")
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(table)
    new.unpersist()
    return n
