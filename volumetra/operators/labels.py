"""Gaze labels from recorded samples: means by TR, a fallback from measured to target positions, fixed numbers of samples a TR, missing blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subject(samples: DataFrame, name: str) -> DataFrame:
    """One subject's rows, found by the text of its id."""
    return samples.where(F.col("participant").cast("string") == name)


def tr_means(samples: DataFrame) -> DataFrame:
    """participant, run, tr, x, y: means that skip missing samples."""
    return samples.groupBy("participant", "run", "tr").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def with_fallback(samples: DataFrame, use_real: bool = True) -> DataFrame:
    """participant, run, tr, rn, x, y, real from measured (rx, ry) and target (tx, ty) positions.

    A participant's run has its measured positions if they are asked for and at least one is there, else its targets; ``real`` says which.
    """
    run = Window.partitionBy("participant", "run")
    real = F.lit(use_real) & (F.count("rx").over(run) > 0)
    s = samples.withColumn("real", real)
    pick = lambda c: F.when(F.col("real"), F.col(f"r{c}")).otherwise(F.col(f"t{c}")).alias(c)
    return s.select("participant", "run", "tr", "rn", pick("x"), pick("y"), "real")


def measured_only(samples: DataFrame) -> DataFrame:
    """participant, run, tr, rn, x, y: measured positions, without a fallback; those that are missing stay missing."""
    return samples.select("participant", "run", "tr", "rn", F.col("rx").alias("x"), F.col("ry").alias("y"))


def per_tr(samples: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """participant, run, tr, sub, x, y: k evenly spaced samples of each expected (participant, run, tr); a TR without samples gives k rows of nulls."""
    key = ["participant", "run", "tr"]
    w = Window.partitionBy(*key)
    s = samples.withColumns({"i": F.row_number().over(w.orderBy("rn")) - 1, "n": F.count(F.lit(1)).over(w)})
    packed = s.groupBy(*key).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y"))), lambda v: F.struct(v["x"], v["y"])).alias("m"))  # one TR's samples
    out = expected.select(*key).join(packed, key, "left").withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    at = F.get("m", F.expr(f"int((sub * (n - 1)) div {k - 1})"))
    return out.withColumn("v", at).select(*key, F.col("sub").cast("long").alias("sub"), F.col("v.x").alias("x"), F.col("v.y").alias("y"))
