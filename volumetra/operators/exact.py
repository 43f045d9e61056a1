"""Exact order statistics of groups of any size, by refinement.

A quantile needs one or two values of known rank. Each round counts the values of a group's range in ``BINS`` parts, in turn of equal width and of equal width in the logarithm, and keeps the one part that holds the rank, with the
least and the greatest value in it; the next round looks only there. About twenty rounds narrow any range of doubles to one value. After a few rounds the part has at most ``ENOUGH`` values, which are then sorted. What any task holds for a group is ``BINS`` counts or ``ENOUGH``
values, whatever the group's size, and counts are added up before they are sent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetra.functions.scalars import between
from volumetra.operators.stored import stored

BINS, ENOUGH = 256, 256


def _part(bins: int, by_size: bool) -> Column:
    """The part of lo .. hi that a value lies in: parts of equal width (halves, so that no difference overflows), or of equal width in the logarithm of the size, which parts what spans many magnitudes."""

    def at(c: str) -> Column:
        v = F.col(c)
        return F.signum(v) * (F.log(F.abs(v)) + 746) if by_size else v / 2

    at_ = {c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(at(c)) for c in ("v", "lo", "hi")}
    share = (at_["v"] - at_["lo"]) / (at_["hi"] - at_["lo"])
    return F.when(at_["hi"] > at_["lo"], F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(F.lit(0))


def ranked(rows: DataFrame, keys: Sequence[str], targets: DataFrame, bins: int = BINS, enough: int = ENOUGH) -> DataFrame:
    """(keys, rank, value): the value of each target (keys, rank from 0, lo, hi, n: least, greatest and number of the group's values) among the rows (keys, v), nulls left out."""
    own = [*keys, "rank"]
    open_ = stored(targets.select(*own, "lo", "hi", "n", F.lit(0).cast("long").alias("below")))
    wide = (F.col("lo") < F.col("hi")) & (F.col("n") > enough)
    values = rows.where("v IS NOT NULL")
    round_ = 0
    while not open_.where(wide).isEmpty():
        inside = values.join(open_.where(wide), list(keys)).where("v BETWEEN lo AND hi")
        counts = inside.groupBy(*own, "below", _part(bins, round_ % 2 == 1).alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*own).orderBy("part")) + F.col("below")  # BINS rows at most
        held = counts.withColumn("upto", upto).where("upto > rank AND upto - c <= rank")
        held = held.select(*own, F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("c").alias("n"), (F.col("upto") - F.col("c")).alias("below"))
        open_ = stored(open_.where(~wide).unionByName(held))
        round_ += 1
    one = open_.where("lo = hi").select(*own, F.col("lo").alias("value"))
    few = values.join(open_.where("lo < hi"), list(keys)).where("v BETWEEN lo AND hi").groupBy(*own, "below").agg(F.sort_array(F.collect_list("v")).alias("s"))  # ENOUGH values at most
    return one.unionByName(few.select(*own, F.get("s", (F.col("rank") - F.col("below")).cast("int")).alias("value")))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], bins: int = BINS, enough: int = ENOUGH) -> DataFrame:
    """(keys, share, value): quantiles of each group, linear between the two nearest values, as ``percentile`` gives them. Missing values don't count; a group without any has no row."""
    v = rows.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    bounds = v.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    place = F.col("share") * (F.col("n") - 1)
    wanted = stored(bounds.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumns({"low": F.floor(place), "high": F.ceil(place), "place": place}))
    targets = wanted.select(*keys, "lo", "hi", "n", F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = stored(ranked(v, keys, targets, bins, enough))
    side = lambda c: found.select(*keys, F.col("rank").alias(c), F.col("value").alias(f"{c}_value"))
    both = wanted.join(side("low"), [*keys, "low"]).join(side("high"), [*keys, "high"])
    value_ = between(F.col("low_value"), F.col("high_value"), F.col("place") - F.col("low"))
    return both.select(*keys, "share", value_.alias("value"))


def medians(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, ``name``)."""
    return quantiles(rows, keys, value, [0.5]).select(*keys, F.col("value").alias(name))


def robust_scores(voxels: DataFrame, keys: Sequence[str] = ("run", "vox"), value: str = "n") -> DataFrame:
    """``voxels`` with ``value`` as its distance from the group's median in median deviations; null where that is 0 or the value is missing."""
    near = voxels.join(medians(voxels, keys, value, "__m"), list(keys), "left").withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    both = near.join(medians(near, keys, "__d", "__s"), list(keys), "left")
    return both.withColumn(value, F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__d", "__s")


def cut_uncertain(p: DataFrame, percent: float = 80) -> DataFrame:
    """``metrics.cut_uncertain`` for participants of any length."""
    limit = quantiles(p, ["participant"], "unc", [percent / 100]).select("participant", F.col("value").alias("__cut"))
    return p.join(limit, "participant").where("unc <= __cut").drop("__cut")
