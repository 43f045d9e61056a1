"""Typed views of the input tables: gaze samples, packed volumes and voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PER_TR = 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, rn (from 0), tr, sub, x (null where the sample dropped out), y, event_type."""
    e = read(spark, sf_dir, "events").withColumnRenamed("user_id", "participant")  # first, so that what follows knows the rows are dealt by it
    rn = F.row_number().over(Window.partitionBy("participant").orderBy("ts", "event_id")) - 1
    g = e.select(
        "participant", rn.cast("long").alias("rn"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "event_type",
    )
    return g.withColumns({"tr": F.expr(f"rn div {PER_TR}"), "sub": F.expr(f"rn % {PER_TR}")})


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, tr, vox (0 to 63), v: one row a voxel."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("run"), F.col("vec_id").alias("tr"), F.posexplode("embedding").alias("vox",
        "v")).withColumns({"vox": F.col("vox").cast("long"), "v": F.col("v").cast("double")})


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tr, x, y, z, v: the volumes as 4 x 4 x 4 grids."""
    return voxels(spark, sf_dir).select("tr", F.expr("vox div 16").alias("x"), F.expr("(vox div 4) % 4").alias("y"), F.expr("vox % 4").alias("z"), "v")


def packed_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, tr, voxels: one row a volume, an array of 64 voxels as a 4 x 4 x 4 grid with z fastest."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("run"), F.col("vec_id").alias("tr"), F.col("embedding").cast("array<double>").alias("voxels"))
