"""Gaze samples as a stream: summaries by participant and time window, with a watermark for late samples; and training batches as a stream that resumes at any batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.operators import splits
from volumetra.sources import parts

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_samples(spark: SparkSession, folder: str, schema: str = SCHEMA, files_a_batch: int = 100) -> DataFrame:
    """participant, at, x (null where the sample dropped out) from Parquet files as they come into a folder."""
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return e.select(F.col("user_id").alias("participant"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") != "error", F.col("value")).alias("x"))


def summaries(samples: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """participant, start, n, missing, mean of each window; state of windows older than the watermark is dropped, so it doesn't grow with the stream."""
    w = samples.withWatermark("at", late).groupBy("participant", F.window("at", window).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean")).select("participant",
        F.col("w.start").alias("start"), "n", "missing", "mean")


def write(stream: DataFrame, path: str, checkpoint: str):
    """Append to a Parquet folder what is there now, then end; the checkpoint makes each window appear once, also after a restart."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(g: DataFrame, steps: int, batch: int, until: int | None = None, a_time: int = 100, mixed: bool = True) -> DataFrame:
    """``splits.batches`` without an end (or up to ``until`` batches) as a stream: (epoch, step, slot, participant, rn, x, y), ``a_time`` batches at once.

    The stream's offset is the number of the next batch and a batch's samples depend on its number alone, so a query that is started again from its checkpoint goes on where it was. ``g`` should
    be a table that is cheap to read, as each turn joins it.
    """
    spark = g.sparkSession
    parts.register(spark)
    options = {"steps": steps, "batch": batch, "batchesPerTrigger": a_time} | ({} if until is None else {"until": until})
    return splits.filled(spark.readStream.format("volumetra_draws").options(**options).load(), g, steps, mixed)
