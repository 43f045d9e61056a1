"""Running operations over signals too long for one task: in two passes over spans of ``SPAN`` samples.

Each span is worked through on its own, by participant and span; one row a span is what it hands on (its last value, its number of flags), a running operation over these rows gives what each
span starts from, and is joined back. Rows are numbered by ranges, so not even the order of a participant's samples asks for all of them in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volumetra.operators.stored import stored

SPAN = 100_000
_KEY = ["participant", "span"]


def numbered(samples: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``samples`` with ``rn``: their number from 0 within the participant, in this order. Ranges of participant and order are sorted on their own; a count for each range and participant says where it starts."""
    by = [F.col(c) for c in ("participant", *order)]
    dealt = samples.repartitionByRange(parts, *by) if parts else samples.repartitionByRange(*by)
    dealt = stored(dealt.sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = dealt.groupBy("__part", "participant").agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("participant").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # ranges
    starts = counts.select("__part", "participant", (before - F.col("__from")).alias("__base"))
    return dealt.join(starts, ["__part", "participant"]).withColumn("rn", F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")


def _spanned(g: DataFrame, span: int) -> DataFrame:
    return g.withColumn("span", F.call_function("div", F.col("rn"), F.lit(span)))


def _within() -> Window:
    return Window.partitionBy(*_KEY).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)


def _carried(g: DataFrame, last: Column, over) -> DataFrame:
    """(participant, span, carried): ``over`` of what the spans before hand on."""
    ends = g.groupBy(*_KEY).agg(last.alias("end"))
    before = Window.partitionBy("participant").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    return ends.select(*_KEY, over(F.col("end")).over(before).alias("carried"))


def forward_fill(g: DataFrame, span: int = SPAN) -> DataFrame:
    """``series.forward_fill`` for participants of any length."""
    s = _spanned(g, span)
    last = F.max(F.when(F.col("x").isNotNull(), F.struct("rn", "x")))
    carried = _carried(s, last, lambda c: F.last(c, ignorenulls=True))
    out = s.withColumn("x", F.last("x", ignorenulls=True).over(_within())).join(carried, _KEY)
    return out.withColumn("x", F.coalesce("x", "carried.x")).drop("span", "carried")


def run_numbers(g: DataFrame, flag: str, span: int = SPAN) -> DataFrame:
    """``series.run_numbers`` for participants of any length."""
    s = _spanned(g, span).withColumn("flag_", F.expr(flag).cast("long"))
    carried = _carried(s, F.sum("flag_"), F.sum)
    out = s.withColumn("run", F.sum("flag_").over(_within())).join(carried, _KEY)
    return out.withColumn("run", F.col("run") + F.coalesce("carried", F.lit(0))).where("flag_ = 0").drop("flag_", "span", "carried")


def segments(g: DataFrame, flag: str, span: int = SPAN) -> DataFrame:
    return run_numbers(g, flag, span).groupBy("participant", "run").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first"), F.max("rn").alias("last"))


def smooth(g: DataFrame, n: int, span: int = SPAN) -> DataFrame:
    """``series.smooth`` for participants of any length: samples next to a span's border are listed in both spans."""
    if span < n:
        raise ValueError(f"spans of {span} samples are shorter than the average over {n}")
    back, ahead = n // 2, (n - 1) // 2
    sizes = g.groupBy("participant").agg(F.count(F.lit(1)).alias("size"))
    s = g.select("participant", "rn", "y").join(sizes, "participant")
    padded = s.unionByName(s.where(F.col("rn") < n).withColumn("rn", F.col("rn") - n)).unionByName(s.where(F.col("rn") >= F.col("size") - n).withColumn("rn", F.col("rn") + n))
    at = lambda by: F.floor((F.col("rn") + by) / span)
    listed = padded.withColumn("span", F.explode(F.sequence(at(-ahead), at(back))))
    w = Window.partitionBy(*_KEY).orderBy("rn").rowsBetween(-back, ahead)
    out = listed.withColumn("y", F.sum("y").over(w) / n)
    return out.where((F.col("span") == at(0)) & (F.col("rn") >= 0) & (F.col("rn") < F.col("size"))).select("participant", "rn", "y")
