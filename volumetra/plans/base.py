"""Queries over gaze samples, labels, splits and volumes, over the whole tables, each with an independent SQL statement to hold it against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.functions import scalars
from volumetra.operators import metrics, packed, series, splits, volume
from volumetra.plans.registry import PRED, C, G, V, card, query, rounded
from volumetra.sources.tables import gaze, grid, packed_volumes, read, voxels


@query(card(PRED) + " SELECT * FROM card")
def gaze_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.scorecard(metrics.predict_by_mean(gaze(spark, sf_dir))))


@query(card(PRED) + " SELECT participant, variant, granularity, metric, value FROM (SELECT participant, variant, granularity, r_mean, r2_mean, e_mean FROM card) UNPIVOT INCLUDE NULLS (value FOR metric IN (r_mean, r2_mean, e_mean))")
def scores_unpivot(spark, sf_dir):
    s = metrics.scorecard(metrics.predict_by_mean(gaze(spark, sf_dir)))
    return rounded(s.unpivot(["participant", "variant", "granularity"], ["r_mean", "r2_mean", "e_mean"], "metric", "value"))


def _normal(first: str) -> str:
    return f"""WITH {V}, n AS (SELECT run, tr, vox, CASE WHEN abs(v) < 0.001 THEN NULL ELSE v END AS v FROM v), {first},
    s AS (SELECT run, tr, vox, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS v FROM t WINDOW w AS (PARTITION BY run, tr)),
    k AS (SELECT *, 5 * stddev_pop(v) OVER (PARTITION BY run) AS b FROM s)
    SELECT run, tr, vox, round(CASE WHEN v IS NULL THEN 0 WHEN v > b THEN b WHEN v < -b THEN -b ELSE v END, 6) AS v FROM k"""


@query(_normal("t AS (SELECT run, tr, vox, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS v FROM n WINDOW w AS (PARTITION BY run, vox))"))
def normalize_mean(spark, sf_dir):
    return rounded(volume.normalize(voxels(spark, sf_dir)))


@query(_normal("m AS (SELECT *, median(v) OVER (PARTITION BY run, vox) AS m FROM n), t AS (SELECT run, tr, vox, (v - m) / nullif(median(abs(v - m)) OVER (PARTITION BY run, vox), 0) AS v FROM m)"))
def normalize_mad(spark, sf_dir):
    return rounded(volume.normalize(voxels(spark, sf_dir), robust=True))


@query(f"""WITH {G}, s AS (SELECT *, sum(CAST(event_type = 'signup' AS INT)) OVER (PARTITION BY participant ORDER BY rn) AS run FROM g) SELECT participant,
    CAST(run AS BIGINT) AS run, count(*) AS n, min(rn) AS first, max(rn) AS last FROM s WHERE event_type <> 'signup' GROUP BY ALL""")
def run_segmentation(spark, sf_dir):
    return series.segments(gaze(spark, sf_dir), "event_type = 'signup'")


@query(f"""WITH {G}, n AS (SELECT participant, count(*) AS n FROM g GROUP BY 1), k AS (SELECT participant, j, (j * (n - 1)) // 9 AS rn FROM n, (SELECT
    unnest(range(0, 10)) AS j)) SELECT participant, j, rn, round(x, 6) AS x, y FROM k JOIN g USING (participant, rn)""")
def linspace_resample(spark, sf_dir):
    return rounded(series.resample(gaze(spark, sf_dir), 10).select("participant", "j", "rn", "x", "y"))


@query(f"""WITH {G}, n AS (SELECT participant, max(rn) AS last FROM g GROUP BY 1), a AS (SELECT participant, rn AS i0, least(rn + 5, last) AS i1 FROM g JOIN
    n USING (participant) WHERE event_type = 'click'), k AS (SELECT participant, i0, j, i0 + (j * (i1 - i0)) // 3 AS rn FROM a, (SELECT
    unnest(range(0, 4)) AS j)) SELECT participant, i0, j, rn, round(x, 6) AS x, y FROM k JOIN g USING (participant, rn)""")
def tr_anchor_resample(spark, sf_dir):
    return rounded(series.anchored(gaze(spark, sf_dir), "event_type = 'click'", 5, 4).select("participant", "i0", "j", "rn", "x", "y"))


@query(f"""WITH {G} SELECT participant, rn, round(last_value(x IGNORE NULLS) OVER (PARTITION BY participant ORDER BY rn ROWS UNBOUNDED PRECEDING), 6) AS x
    FROM g""")
def ffill_trace(spark, sf_dir):
    return rounded(series.forward_fill(gaze(spark, sf_dir)).select("participant", "rn", "x"))


@query(f"""WITH {G}, n AS (SELECT participant, count(*) AS n FROM g GROUP BY 1), s AS (SELECT participant, rn, y, n FROM g JOIN n USING (participant)),
p AS (SELECT * FROM s UNION ALL SELECT participant, rn - 4, y, n FROM s WHERE rn < 4 UNION ALL SELECT participant, rn + 4, y, n FROM s WHERE rn >= n - 4),
w AS (SELECT participant, rn, n, sum(y) OVER (PARTITION BY participant ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS y FROM p) SELECT
participant, rn, round(y, 6) AS y FROM w WHERE rn >= 0 AND rn < n""")
def smooth_signal(spark, sf_dir):
    return rounded(series.smooth(gaze(spark, sf_dir), 4))


@query("""SELECT (c_custkey - 1) * 5 + k AS tr, j AS sub, round(((px + 0.95::DOUBLE) / 1.9::DOUBLE - 0.5::DOUBLE) * 19, 6) AS x, round(-((py +
0.95::DOUBLE) / 1.9::DOUBLE - 0.5::DOUBLE) * 14.7::DOUBLE, 6) AS y
FROM (SELECT c_custkey, 0.95::DOUBLE * ((c_custkey * 7) % 39 - 19) / 19 AS px, 0.95::DOUBLE * ((c_custkey * 11) % 39 - 19) / 19 AS py FROM customer),
(SELECT unnest(range(0, 5)) AS k), (SELECT unnest(range(0, 10)) AS j)""")
def label_expand(spark, sf_dir):
    p = read(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).alias("i"),
        *[(F.lit(0.95) * ((F.col("c_custkey") * m) % 39 - 19) / 19).alias(c) for c, m in (("px", 7), ("py", 11))])
    return rounded(series.expand_labels(p))


@query(f"""WITH {G} SELECT participant, rn, round(x - median(x) OVER w, 6) AS x, round(y - median(y) OVER w, 6) AS y FROM g WINDOW w AS (PARTITION BY
    participant)""")
def label_center(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("participant")
    return rounded(gaze(spark, sf_dir).select("participant", "rn", *[(F.col(c) - F.median(c).over(w)).alias(c) for c in ("x", "y")]))


@query("""SELECT c_nationkey, c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey * 7919 + 13) % 100003, c_custkey) <=
    floor(0.6::DOUBLE * count(*) OVER (PARTITION BY c_nationkey)) THEN 'train' ELSE 'test' END AS part FROM customer""")
def holdout_split(spark, sf_dir):
    return splits.holdout(read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 0.6)


@query("""WITH u AS (SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT
    h.r_name AS held_out, c_custkey, CASE WHEN u.r_name = h.r_name THEN 'test' ELSE 'train' END AS part FROM u, (SELECT DISTINCT r_name FROM u) h""")
def leave_one_dataset_out(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    u = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    return splits.leave_one_out(u, "r_name", "c_custkey")


@query(f"""WITH {G}, n AS (SELECT *, max(tr) OVER (PARTITION BY participant) + 1 AS n FROM g) SELECT participant, tr, count(*) AS samples, CASE WHEN tr <
    floor(0.7::DOUBLE * n) THEN 'train' ELSE 'test' END AS part FROM n GROUP BY participant, tr, n""")
def within_subject_split(spark, sf_dir):
    return splits.within(gaze(spark, sf_dir), 0.0, 0.7).groupBy("participant", "tr", "part").agg(F.count(F.lit(1)).alias("samples"))


@query(f"""WITH {C} SELECT tr, x - 2 AS x, y - 1 AS y, z, round(v, 6) AS v FROM c WHERE x >= 2 AND x < 4 AND y >= 1 AND y < 4 AND z < 3 UNION ALL SELECT tr,
    x + 2, y - 1, z, round(v, 6) FROM c WHERE x < 2 AND y >= 1 AND y < 4 AND z < 3""")
def crop_stack(spark, sf_dir):
    g = grid(spark, sf_dir)
    return rounded(volume.stack(volume.crop(g, (2, 4), (1, 4), (0, 3)), volume.crop(g, (0, 2), (1, 4), (0, 3)), 2))


@query(f"WITH {C} SELECT tr, x, y, z, round(CASE WHEN (x + y + z) % 2 = 0 THEN v ELSE 0 END, 6) AS v FROM c")
def mask_fill(spark, sf_dir):
    mask = spark.range(64).select(*[F.expr(e).alias(c) for c, e in zip("xyz", ("id div 16", "(id div 4) % 4", "id % 4"))]).where("(x + y + z) % 2 = 0")
    return rounded(volume.fill_outside(grid(spark, sf_dir), mask).select("tr", "x", "y", "z", "v"))


@query(f"""WITH {V}, m AS (SELECT run, tr, avg(v) AS m FROM v GROUP BY ALL) SELECT run, tr, round((m - min(m) OVER w) / nullif(max(m) OVER w - min(m) OVER w,
    0), 6) AS v FROM m WINDOW w AS (PARTITION BY run)""")
def timecourse_minmax(spark, sf_dir):
    return rounded(volume.minmax_course(voxels(spark, sf_dir)))


@query(f"""WITH {C} SELECT 'x' AS axis, y AS a, z AS b, round(avg(v), 6) AS v FROM c GROUP BY ALL UNION ALL SELECT 'y', x, z, round(avg(v), 6) FROM c GROUP
    BY x, z UNION ALL SELECT 'z', x, y, round(avg(v), 6) FROM c GROUP BY x, y""")
def axis_projections(spark, sf_dir):
    cube = grid(spark, sf_dir).groupBy("x", "y", "z").agg(F.sum("v").alias("s"), F.count("v").alias("n"))  # one pass over the voxels, the projections over 64 sums
    one = lambda axis, a, b: cube.groupBy(F.lit(axis).alias("axis"), F.col(a).alias("a"), F.col(b).alias("b")).agg((F.sum("s") / F.sum("n")).alias("v"))
    return rounded(one("x", "y", "z").unionByName(one("y", "x", "z")).unionByName(one("z", "x", "y")))


@query(f"""WITH {V}, m AS (SELECT vox, avg(v) AS m FROM v GROUP BY 1) SELECT count(*) AS n, round(sum(v), 4) AS total, round(avg(v), 6) AS mean,
    round(stddev_pop(v), 6) AS std, round(median(v), 6) AS med, count(*) FILTER (abs(v) < 0.001) AS missing, (SELECT count(*) FROM m WHERE m > 0) AS
    positive_voxels FROM v""")
def voxel_stats(spark, sf_dir):
    v = voxels(spark, sf_dir)
    s = v.agg(F.count("v").alias("n"), F.round(F.sum("v"), 4).alias("total"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.median("v").alias("med"), F.count_if(F.abs("v") < 0.001).alias("missing"))
    return rounded(s.join(v.groupBy("vox").agg(F.avg("v").alias("m")).agg(F.count_if(F.col("m") > 0).alias("positive_voxels"))))  # one row each


@query("""SELECT CAST(floor((value - lo) / w) AS BIGINT) AS bin, count(*) AS n, round(min(value), 6) AS least FROM events, (SELECT min(value) AS lo,
    (max(value) - min(value)) / 75 AS w FROM events WHERE value > 0) WHERE value > 0 GROUP BY 1""")
def histogram(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value > 0").select("value")
    edges = e.agg(F.min("value").alias("lo"), ((F.max("value") - F.min("value")) / 75).alias("w"))  # one row
    return rounded(e.join(F.broadcast(edges)).groupBy(F.floor((F.col("value") - F.col("lo")) / F.col("w")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least")))


@query("""SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS
    q3, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1""")
def boxplot(spark, sf_dir):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    b = read(spark, sf_dir, "events").groupBy("event_type").agg(q.alias("q"), F.min("value").alias("low"), F.max("value").alias("high"))
    return rounded(b.select("event_type", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)], "low", "high"))


@query("""SELECT event_id, round(s * tanh(ln(1 + exp(s))), 6) AS mish, round(0.001::DOUBLE * pow(1 - (event_id % 25) / 25::DOUBLE, 0.9::DOUBLE), 9) AS rate
    FROM (SELECT event_id, value / 100 - 1 AS s FROM events)""")
def mish_lr(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.round(scalars.mish(F.col("value") / 100 - 1), 6).alias("mish"), F.round(scalars.poly_rate(0.001,
        F.col("event_id") % 25, 25), 9).alias("rate"))


@query(f"""WITH {PRED} SELECT participant, round(avg(sqrt((tx - px) ** 2 + (ty - py) ** 2)), 6) AS euclid, round(avg((sqrt((tx - px) ** 2 + (ty - py) ** 2) -
    unc) ** 2), 6) AS confidence FROM q GROUP BY 1""")
def confidence_loss(spark, sf_dir):
    c = F.col
    e = scalars.euclid(c("tx"), c("ty"), c("px"), c("py"))
    return rounded(metrics.predict_by_mean(gaze(spark, sf_dir)).groupBy("participant").agg(F.avg(e).alias("euclid"),
        F.avg((e - c("unc")) * (e - c("unc"))).alias("confidence")))


@query(f"""WITH {PRED} SELECT participant, tr, round(median(px), 6) AS x, round(median(py), 6) AS y, round(median(abs(unc)), 6) AS uncertainty FROM q GROUP
    BY 1, 2""")
def gaze_export_tr(spark, sf_dir):
    p = metrics.predict_by_mean(gaze(spark, sf_dir))
    return rounded(p.groupBy("participant", "tr").agg(F.median("px").alias("x"), F.median("py").alias("y"), F.median(F.abs("unc")).alias("uncertainty")))


@query(f"WITH {PRED} SELECT participant, tr, sub, round(px, 6) AS x, round(py, 6) AS y, round(abs(unc), 6) AS pred_error FROM q")
def gaze_export_subtr(spark, sf_dir):
    p = metrics.predict_by_mean(gaze(spark, sf_dir))
    return rounded(p.select("participant", "tr", "sub", F.col("px").alias("x"), F.col("py").alias("y"), F.abs("unc").alias("pred_error")))


@query(f"""WITH {G}, {V}, d AS (SELECT run, tr, row_number() OVER (PARTITION BY run ORDER BY tr) - 1 AS i, avg(v) AS m FROM v GROUP BY run, tr), l AS
(SELECT participant % 10 AS run, participant, tr AS i, median(x) AS x FROM g GROUP BY 1, 2, 3)
SELECT l.participant, d.run, d.tr, round(d.m, 6) AS mean, round(l.x, 6) AS x FROM d JOIN l ON d.run = l.run AND d.i = l.i""")
def align_labels(spark, sf_dir):
    from pyspark.sql import Window

    d = voxels(spark, sf_dir).groupBy("run", "tr").agg(F.avg("v").alias("mean")).withColumn("i",
        (F.row_number().over(Window.partitionBy("run").orderBy("tr")) - 1).cast("long"))
    g = gaze(spark, sf_dir).groupBy((F.col("participant") % 10).alias("run"), "participant", F.col("tr").alias("i")).agg(F.median("x").alias("x"))
    return rounded(d.join(g, ["run", "i"]).select("participant", "run", "tr", "mean", "x"))


@query("""SELECT c_custkey, regexp_extract(p, '([^/]*)$', 1) AS base, regexp_extract(p, '([^/.]*)[^/]*$', 1) AS stem, regexp_extract(p, '^(.*)/[^/]*$', 1)
    AS folder, right(regexp_extract(p, '([^/.]*)[^/]*$', 1), 7) AS short FROM (SELECT c_custkey, '/data/' || c_mktsegment || '/' || c_name ||
    '.nii.gz' AS p FROM customer)""")
def path_strings(spark, sf_dir):
    p = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".nii.gz")).alias("p"))
    stem = F.substring_index(F.substring_index("p", "/", -1), ".", 1)
    return p.select("c_custkey", F.substring_index("p", "/", -1).alias("base"), stem.alias("stem"), F.regexp_extract("p", r"^(.*)/[^/]*$",
        1).alias("folder"), F.right(stem, F.lit(7)).alias("short"))


