"""Sampled signals: resampling, segmentation, smoothing and filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resample(g: DataFrame, k: int) -> DataFrame:
    """k evenly spaced samples of each participant; fewer samples repeat."""
    n = g.groupBy("participant").agg(F.count(F.lit(1)).alias("n"))
    want = n.select("participant", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j")).select("participant",
        F.col("j").cast("long").alias("j"), F.expr(f"(j * (n - 1)) div {k - 1}").alias("rn"))
    return want.join(g, ["participant", "rn"])


def anchored(g: DataFrame, flag: str, span: int, k: int) -> DataFrame:
    """k samples from each flagged row over the next ``span`` rows, its end included."""
    n = g.groupBy("participant").agg(F.max("rn").alias("last"))
    a = g.where(flag).select("participant", F.col("rn").alias("i0")).join(n, "participant").withColumn("i1", F.least(F.col("i0") + span, "last"))
    a = a.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("participant", "i0", F.col("j").cast("long").alias("j"),
        F.expr(f"i0 + (j * (i1 - i0)) div {k - 1}").alias("rn"))
    return a.join(g.select("participant", "rn", "x", "y"), ["participant", "rn"])


def by_time(order: str = "rn"):
    return Window.partitionBy("participant").orderBy(order)


def run_numbers(g: DataFrame, flag: str) -> DataFrame:
    """``g`` without its flagged rows, with ``run``: how many flagged rows came before."""
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("is_flag", F.expr(flag)).withColumn("run", F.sum(F.col("is_flag").cast("long")).over(w)).where("not is_flag").drop("is_flag")


def renumbered(g: DataFrame) -> DataFrame:
    """``rn`` from 0 on within each participant."""
    return g.withColumn("rn", (F.row_number().over(by_time()) - 1).cast("long"))


def segments(g: DataFrame, flag: str) -> DataFrame:
    """Runs that a flagged row closes; empty runs vanish."""
    return run_numbers(g, flag).groupBy("participant", "run").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first"), F.max("rn").alias("last"))


def least_gap(g: DataFrame, flag: str) -> DataFrame:
    """participant, least_gap, gaps: the least and the number of different distances between flagged rows."""
    d = g.where(flag).withColumn("gap", F.col("rn") - F.lag("rn").over(by_time()))
    return d.groupBy("participant").agg(F.min("gap").alias("least_gap"), F.countDistinct("gap").alias("gaps"))


def require_spacing(g: DataFrame, flag: str, gap: int) -> DataFrame:
    """``g``, but reading it fails if a participant's flagged rows are ever closer than ``gap``."""
    d = g.withColumn("at", F.when(F.expr(flag), F.col("rn")))
    last = F.last("at", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, -1))
    close = F.col("at").isNotNull() & (F.col("at") - last < gap)
    failed = F.when(close, F.raise_error(F.concat(F.lit("flags closer than expected at row "), F.col("rn").cast("string")))).otherwise(F.lit(None))
    return d.withColumn("failed", failed.cast("string")).where("failed is null").drop("at", "failed")


def forward_fill(g: DataFrame) -> DataFrame:
    w = Window.partitionBy("participant").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("x", F.last("x", ignorenulls=True).over(w))


def smooth(g: DataFrame, n: int) -> DataFrame:
    """Moving average; the signal is padded in order with its first and last n samples."""
    size = F.count(F.lit(1)).over(Window.partitionBy("participant"))
    s = g.select("participant", "rn", "y", size.alias("size"))
    padded = s.unionByName(s.where(F.col("rn") < n).withColumn("rn",
        F.col("rn") - n)).unionByName(s.where(F.col("rn") >= F.col("size") - n).withColumn("rn", F.col("rn") + n))
    w = Window.partitionBy("participant").orderBy("rn").rowsBetween(-(n // 2), (n - 1) // 2)
    out = padded.withColumn("y", F.sum("y").over(w) / n)
    return out.where((F.col("rn") >= 0) & (F.col("rn") < F.col("size"))).select("participant", "rn", "y")


def expand_labels(points: DataFrame, trs: int = 5, subs: int = 10) -> DataFrame:
    """Each point (i, px, py in [-0.95, 0.95]) for ``trs`` TRs and ``subs`` samples, in degrees."""
    out = points.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(trs - 1)))).withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))))
    scale = lambda c: (F.col(c) + 0.95) / 1.9 - 0.5
    return out.select((F.col("i") * trs + F.col("k")).cast("long").alias("tr"), F.col("sub").cast("long").alias("sub"), (scale("px") * 19).alias("x"),
        (-scale("py") * 14.7).alias("y"))
