"""Queries whose groups may be of any size: order statistics by refinement, running operations in two passes; and the hook for other aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.functions.scalars import euclid
from volumetra.operators import exact, metrics, spans, volume
from volumetra.plans.registry import ORACLES, PRED, card, query, rounded
from volumetra.sources.tables import gaze, read, voxels

#: Short enough that every participant of the test tables has several spans.
SPAN = 50


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, rn, x, y, event_type, numbered without a task that gets all samples of a participant."""
    e = read(spark, sf_dir, "events").withColumnRenamed("user_id", "participant")
    x, y = F.when(F.col("event_type") != "error", F.col("value")), F.get_json_object("props", "$.k").cast("double")
    return spans.numbered(e.select("participant", "ts", "event_id", x.alias("x"), y.alias("y"), "event_type"), ["ts", "event_id"])


@query(ORACLES["ffill_trace"])
def ffill_spans(spark, sf_dir):
    return rounded(spans.forward_fill(_samples(spark, sf_dir), SPAN).select("participant", "rn", "x"))


@query(ORACLES["run_segmentation"])
def segment_spans(spark, sf_dir):
    return spans.segments(_samples(spark, sf_dir), "event_type = 'signup'", SPAN)


@query(ORACLES["smooth_signal"])
def smooth_spans(spark, sf_dir):
    return rounded(spans.smooth(_samples(spark, sf_dir), 4, SPAN))


@query(ORACLES["boxplot"])
def boxplot_refined(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    q = exact.quantiles(e, ["event_type"], "value", [0.25, 0.5, 0.75])
    ends = e.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    wide = q.groupBy("event_type").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(c) for c, s in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    return rounded(wide.join(ends, "event_type").select("event_type", "q1", "q2", "q3", "low", "high"))


@query(ORACLES["normalize_mad"])
def normalize_mad_refined(spark, sf_dir):
    return rounded(volume.normalize(voxels(spark, sf_dir), robust=True, refined=True))


@query(card(PRED) + " SELECT participant, e_median FROM card WHERE variant = 'refined' AND granularity = 'subtr' AND e_median IS NOT NULL")
def error_median_refined(spark, sf_dir):
    """The median error of the samples below each participant's 80th percentile of uncertainty, both by refinement."""
    kept = exact.cut_uncertain(metrics.complete_trs(metrics.predict_by_mean(gaze(spark, sf_dir))))
    e = kept.select("participant", euclid(F.col("tx"), F.col("ty"), F.col("px"), F.col("py")).alias("e"))
    return rounded(exact.medians(e, ["participant"], "e", "e_median"))


def _trimmed(c: str) -> str:
    return f"CASE WHEN count(*) > count({c}) THEN NULL WHEN count(*) > 2 THEN (sum({c}) - min({c}) - max({c})) / (count(*) - 2) ELSE avg({c}) END AS {c}"


@query(f"""WITH {PRED}, t AS (SELECT participant, tr, {', '.join(_trimmed(c) for c in ('tx', 'ty', 'px', 'py'))} FROM q GROUP BY ALL)
    SELECT participant, round(avg(sqrt((tx - px) ** 2 + (ty - py) ** 2)), 6) AS e_mean, round(median(sqrt((tx - px) ** 2 + (ty - py) ** 2)), 6) AS e_median
    FROM t WHERE tx IS NOT NULL AND ty IS NOT NULL GROUP BY 1""")
def scorecard_trimmed(spark, sf_dir):
    """The scores by TR with a trimmed mean, an aggregate that is registered for SQL, in place of the median."""
    metrics.register_hook(spark, "trimmed_mean", metrics.trimmed_mean, metrics.trimmed_means)
    coarse = metrics.by_tr_hook(metrics.predict_by_mean(gaze(spark, sf_dir)), "trimmed_mean")
    return rounded(metrics.scorecard_by_tr(coarse).select("participant", "e_mean", "e_median"))
