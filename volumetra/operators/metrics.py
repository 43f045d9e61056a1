"""Scoring of predicted gaze against the truth."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volumetra.functions.scalars import between, euclid, pearson, r2, strict_median

VALUES = ("tx", "ty", "px", "py", "unc")


def predict_by_mean(gaze: DataFrame, width: int = 5) -> DataFrame:
    """A stand-in predictor: the centred mean of ``width`` samples; its uncertainty is the distance of x from it."""
    w = Window.partitionBy("participant").orderBy("rn").rowsBetween(-(width // 2), width // 2)
    out = gaze.withColumns({"px": F.avg("x").over(w), "py": F.avg("y").over(w)})
    return out.withColumn("unc", F.abs(F.col("x") - F.col("px"))).withColumnsRenamed({"x": "tx", "y": "ty"})


def complete_trs(p: DataFrame) -> DataFrame:
    """Only TRs without a missing label."""
    w = Window.partitionBy("participant", "tr")
    n = F.count(F.lit(1)).over(w)
    return p.withColumn("__ok", (F.count("tx").over(w) == n) & (F.count("ty").over(w) == n)).where("__ok").drop("__ok")


def nonempty(p: DataFrame) -> DataFrame:
    """Only participants with at least one complete TR."""
    return p.join(complete_trs(p).select("participant").distinct(), "participant", "left_semi")


def by_tr(p: DataFrame, functor: Callable[[Column], Column] = strict_median) -> DataFrame:
    """One row a TR; ``functor`` makes one value of its samples."""
    return p.groupBy("participant", "tr").agg(*[functor(F.col(c)).alias(c) for c in VALUES])


def with_quantile(rows: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """``rows`` with ``name``: the quantile of ``value`` in the group, between the two nearest values as ``between`` has it. One sort by keys and value; nulls don't count."""
    own = Window.partitionBy(*keys)
    at = F.row_number().over(own.orderBy(F.col(value).asc_nulls_last())) - 1
    out = rows.withColumn("__at", at).withColumn("__place", share * (F.count(value).over(own) - 1))
    side = lambda rank: F.max(F.when(F.col("__at") == rank, F.col(value))).over(own)
    out = out.withColumns({"__lo": side(F.floor("__place")), "__hi": side(F.ceil("__place"))})
    return out.withColumn(name, between(F.col("__lo"), F.col("__hi"), F.col("__place") - F.floor("__place"))).drop("__at", "__place", "__lo", "__hi")


def cut_uncertain(p: DataFrame, percent: float = 80) -> DataFrame:
    """Drop rows of a participant above the percentile of uncertainty."""
    return with_quantile(p, ["participant"], "unc", percent / 100, "__cut").where(F.col("unc") <= F.col("__cut")).drop("__cut")


def _scores() -> list[Column]:
    t, q, u, v = F.col("tx"), F.col("px"), F.col("ty"), F.col("py")
    e = euclid(t, u, q, v)
    return [
        pearson(t, q).alias("r_x"), pearson(u, v).alias("r_y"), r2(t, q).alias("r2_x"), r2(u, v).alias("r2_y"),
        F.avg(e).alias("e_mean"), F.median(e).alias("e_median"), F.stddev_pop(e).alias("e_std"),
    ]


def scorecard(p: DataFrame, percent: float = 80, functor: Callable[[Column], Column] = strict_median) -> DataFrame:
    """Four rows a participant: all or refined, by sample or by TR; participants without a complete TR get nulls.

    Each TR becomes one row with its samples and what ``functor`` makes of them, is taken apart into the rows of both granularities, and each row
    is listed for both variants, without values where the variant leaves it out. All steps group by participant first, so whatever is dealt by participant
    is dealt once.
    """
    n = F.count(F.lit(1))
    sample = F.struct(F.lit("subtr").alias("granularity"), *VALUES)
    per_tr = p.groupBy("participant", "tr").agg(
        F.collect_list(sample).alias("samples"), *[functor(F.col(c)).alias(c) for c in VALUES], ((F.count("tx") == n) & (F.count("ty") == n)).alias("complete")
    )
    coarse = F.struct(F.lit("tr").alias("granularity"), *VALUES)
    nothing = lambda g: F.struct(F.lit(g).alias("granularity"), *[F.lit(None).cast("double").alias(c) for c in VALUES])
    rows = F.when(F.col("complete"), F.concat("samples", F.array(coarse))).otherwise(F.array(nothing("subtr"), nothing("tr")))
    rows = per_tr.select("participant", F.explode(rows).alias("r")).select("participant", "r.*")
    rows = with_quantile(rows, ["participant", "granularity"], "unc", percent / 100, "cut")
    kept = F.col("unc") <= F.col("cut")
    every = F.struct(F.lit("all").alias("variant"), *VALUES)
    refined = F.struct(F.lit("refined").alias("variant"), *[F.when(kept, F.col(c)).alias(c) for c in VALUES])
    both = rows.select("participant", "granularity", F.explode(F.array(every, refined)).alias("v")).select("participant", "granularity", "v.*")
    s = both.groupBy("participant", "variant", "granularity").agg(*_scores())
    means = {"r_mean": (F.col("r_x") + F.col("r_y")) / 2, "r2_mean": (F.col("r2_x") + F.col("r2_y")) / 2}
    return s.withColumns(means).select("participant", "variant", "granularity", "r_x", "r_y", "r_mean", "r2_x", "r2_y", "r2_mean", "e_mean", "e_median", "e_std")


def register_hook(spark: SparkSession, name: str, one: Callable[[pd.Series], float | None], many: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
    """Make ``one`` an aggregate for SQL and for ``by_tr_hook``: it gets the samples of a group, missing ones as NaN, and gives one number. A group must be small, as that of a TR is.

    ``by_tr_hook`` calls ``many`` instead, if there is one, once for a batch of groups: with all their samples, group by group, and where each group starts; it gives a number a group, NaN for none.
    """

    def aggregate(v: pd.Series) -> float:
        return one(v.astype(float))

    def lists(groups: pa.Array) -> pa.Array:
        values, sizes = groups.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(groups).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        out = many(values, starts) if many else [one(pd.Series(v)) for v in np.split(values, starts[1:])]
        return pa.array(np.asarray(out, float), from_pandas=True)

    spark.udf.register(name, F.pandas_udf(aggregate, "double"))
    spark.udf.register(f"{name}_of_lists", F.arrow_udf(lists, "double"))


def trimmed_mean(v: pd.Series) -> float | None:
    """Without the least and the greatest of three values or more; null if one is missing."""
    if v.isna().any():
        return None
    return float(v.sort_values().iloc[1:-1].mean()) if len(v) > 2 else float(v.mean())


def trimmed_means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``trimmed_mean`` of many groups; a missing value is sorted to its group's end."""
    sizes = np.diff(np.append(starts, len(values)))
    order = np.lexsort((values, np.repeat(np.arange(len(starts)), sizes)))
    v, last, cut = values[order], starts + sizes - 1, sizes > 2
    missing = np.isnan(v[last])
    v[starts[cut]] = v[last[cut]] = 0
    return np.where(missing, np.nan, np.add.reduceat(v, starts) / np.where(cut, sizes - 2, sizes))


def by_tr_hook(p: DataFrame, hook: str) -> DataFrame:
    """One row a TR with what a registered aggregate makes of its samples, missing ones as NaN. Groups go to Python as lists, many in an Arrow batch."""
    lists = p.groupBy("participant", "tr").agg(*[F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))).alias(c) for c in VALUES])
    return lists.select("participant", "tr", *[F.call_function(f"{hook}_of_lists", F.col(c)).alias(c) for c in VALUES])


def scorecard_by_tr(coarse: DataFrame) -> DataFrame:
    """participant and the scores of rows by TR (participant, tx, ty, px, py, unc); participants without a whole row have none."""
    return coarse.where("tx IS NOT NULL AND ty IS NOT NULL").groupBy("participant").agg(*_scores())
