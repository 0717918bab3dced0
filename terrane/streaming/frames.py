"""Streaming forms of the frame operators: windowed levels and speech stretches, with watermarks for late frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of the stored frames; a stream needs it stated.
FRAMES = (
    "utt_id string, source_id string, site_id string, frame_no int, ts timestamp_ntz, energy double, f0 double, voicing float, "
    "fmt array<double>, speech boolean, loaded_at timestamp_ntz"
)


def read(spark: SparkSession, folder: str, late: str = "10 minutes", files_per_batch: int = 8) -> DataFrame:
    """Frames as a stream of the Parquet files in a folder, times without zone taken as the session's; the watermark is set
    here, once for all that follows."""
    raw = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def once(frames: DataFrame) -> DataFrame:
    """Each frame once within the watermark: repeats and re-sent utterances drop out, the state stays bounded."""
    return frames.dropDuplicatesWithinWatermark(["utt_id", "frame_no"])


def levels(frames: DataFrame, window: str = "1 hour") -> DataFrame:
    """(window, source_id, n, mean, sd): frame energy by source and event-time window, finite readings only."""
    ok = F.col("energy").isNotNull() & ~F.isnan("energy") & (F.abs("energy") < float("inf"))
    return frames.filter(ok).groupBy(F.window("ts", window), "source_id").agg(
        F.count("*").alias("n"), F.avg("energy").alias("mean"), F.stddev_pop("energy").alias("sd"))


def stretches(frames: DataFrame, gap: str = "200 milliseconds") -> DataFrame:
    """(session, utt_id, n): speech stretches, sessions of speech frames that are parted by at least ``gap``."""
    return frames.filter("speech").groupBy(F.session_window("ts", gap), "utt_id").agg(F.count("*").alias("n"))
