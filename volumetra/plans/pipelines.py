"""Queries over labels, splits, batches and whole evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.functions import scalars
from volumetra.operators import labels, metrics, predict, series, splits
from volumetra.plans.registry import PRED, G, V, card, query, rounded
from volumetra.sources.masks import runs_of_log
from volumetra.sources.tables import gaze, packed_volumes, read


@query(f"""WITH {G}, d AS (SELECT participant, rn - lag(rn) OVER (PARTITION BY participant ORDER BY rn) AS gap FROM g WHERE event_type = 'click') SELECT
    participant, min(gap) AS least_gap, count(DISTINCT gap) AS gaps FROM d GROUP BY 1""")
def flag_spacing(spark, sf_dir):
    return series.least_gap(gaze(spark, sf_dir), "event_type = 'click'")


@query(f"""WITH {PRED}, d AS (SELECT participant, rn, tx, px - tx AS dx, CASE WHEN abs(py - ty) <= 0.000001 THEN 0 ELSE py - ty END AS dy FROM q)
    SELECT participant, rn, round(sqrt(dx ** 2 + dy ** 2), 6) AS dist, round(atan2(dy, dx) + pi(), 6) AS angle FROM d""")
def angle_euclid(spark, sf_dir):
    """Distance and direction of each prediction from the truth; differences in y under 1e-6 count as none, missing samples give nulls."""
    d = metrics.predict_by_mean(gaze(spark, sf_dir)).select("participant", "rn", (F.col("px") - F.col("tx")).alias("dx"), (F.col("py") - F.col("ty")).alias("dy"))
    d = d.withColumn("dy", F.when(F.abs("dy") <= 1e-6, 0.0).otherwise(F.col("dy")))
    zero = F.lit(0.0)
    return rounded(d.select("participant", "rn", scalars.euclid(F.col("dx"), F.col("dy"), zero, zero).alias("dist"), scalars.angle(F.col("dx"),
        F.col("dy")).alias("angle")))


_ORDER = "((participant * 7919 + 13) % 100003) % 1024, participant"


@query(f"""WITH u AS (SELECT participant, ntile(5) OVER (ORDER BY {_ORDER}) - 1 AS own FROM (SELECT DISTINCT user_id AS participant FROM events))
    SELECT fold, participant, CASE WHEN fold = own THEN 'test' ELSE 'train' END AS part FROM u, (SELECT unnest(range(0, 5)) AS fold)""")
def cv_folds(spark, sf_dir):
    return splits.folds(read(spark, sf_dir, "events").select(F.col("user_id").alias("participant")).distinct(), "participant", 5)


_PEOPLE = f"n AS (SELECT participant, count(*) AS n FROM g GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS i, count(*) OVER () AS m FROM n)"
_PICK = "(id * 104729 + 7) % 99991 % n"


@query(f"""WITH {G}, {_PEOPLE}, s AS (SELECT id, ((id * 7919 + 13) % 100003) % (SELECT max(m) FROM i) AS i FROM (SELECT unnest(range(0, 1000)) AS id))
    SELECT d.slot, d.participant, d.rn, round(x, 6) AS x, y FROM (SELECT id AS slot, participant, {_PICK} AS rn FROM s JOIN i USING (i)) d JOIN g
    USING (participant, rn)""")
def mixed_batch_sample(spark, sf_dir):
    return rounded(splits.mixed_batch(gaze(spark, sf_dir), 1000))


def _stream(key: str) -> str:
    return f"""WITH {G}, {_PEOPLE}, s AS (SELECT id, (({key} * 7919 + 13) % 100003) % (SELECT max(m) FROM i) AS i FROM (SELECT unnest(range(0, 480)) AS id))
    SELECT d.id // 160 AS epoch, d.id // 16 % 10 AS step, d.id % 16 AS slot, d.participant, d.rn, round(x, 6) AS x, y
    FROM (SELECT id, participant, {_PICK} AS rn FROM s JOIN i USING (i)) d JOIN g USING (participant, rn)"""


@query(_stream("id"))
def epoch_batches(spark, sf_dir):
    """Three epochs of ten steps of sixteen samples, each of a participant of its own."""
    return rounded(splits.batches(gaze(spark, sf_dir), 3, 10, 16))


@query(_stream("(id // 16)"))
def own_batches(spark, sf_dir):
    """The same, but each step's samples come from one participant."""
    return rounded(splits.batches(gaze(spark, sf_dir), 3, 10, 16, mixed=False))


@query(f"""WITH {G}, n AS (SELECT participant, count(*) AS n FROM g GROUP BY 1),
    d AS (SELECT participant, draw, (draw * 104729 + participant * 7919 + 7) % 99991 % n AS rn FROM n, (SELECT unnest(range(0, 8)) AS draw))
    SELECT participant, draw, rn, round(x, 6) AS x, y FROM d JOIN g USING (participant, rn)""")
def own_draws(spark, sf_dir):
    return rounded(splits.own_draws(gaze(spark, sf_dir), 8))


_OK = "ok AS (SELECT participant, tr FROM q GROUP BY ALL HAVING count(*) = count(tx) AND count(*) = count(ty))"


@query(f"WITH {PRED}, {_OK} SELECT participant, row_number() OVER (PARTITION BY participant ORDER BY tr) - 1 AS i, tr FROM ok")
def complete_index(spark, sf_dir):
    """The complete TRs of each participant, numbered."""
    return splits.complete_index(metrics.predict_by_mean(gaze(spark, sf_dir)))


@query(f"WITH {PRED}, {_OK} SELECT participant, count(*) AS samples, count(tx) AS there FROM q WHERE participant IN (SELECT participant FROM ok) GROUP BY 1")
def drop_empty(spark, sf_dir):
    """Samples of the participants with a complete TR."""
    p = metrics.nonempty(metrics.predict_by_mean(gaze(spark, sf_dir)))
    return p.groupBy("participant").agg(F.count(F.lit(1)).alias("samples"), F.count("tx").alias("there"))


_UNITS = "u AS (SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA'))"
_HASH = "(c_custkey * 7919 + 13) % 100003"


@query(f"""WITH {_UNITS}
    SELECT 'holdout' AS how, '0' AS round, c_custkey,
      CASE WHEN row_number() OVER (PARTITION BY r_name ORDER BY {_HASH}, c_custkey) <= floor(0.6::DOUBLE * count(*) OVER (PARTITION BY r_name)) THEN
      'train' ELSE 'test' END AS part FROM u
    UNION ALL SELECT 'folds', CAST(fold AS VARCHAR), c_custkey, CASE WHEN fold = own THEN 'test' ELSE 'train' END
      FROM (SELECT c_custkey, ntile(4) OVER (ORDER BY ({_HASH}) % 1024, c_custkey) - 1 AS own FROM u), (SELECT unnest(range(0, 4)) AS fold)
    UNION ALL SELECT 'leave_one_out', h.r_name, c_custkey, CASE WHEN u.r_name = h.r_name THEN 'test' ELSE 'train' END FROM u, (SELECT DISTINCT r_name FROM u) h""")
def split_factory(spark, sf_dir):
    """All ways of splitting over three of the datasets."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    u = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    ways = [splits.split(u, how, "c_custkey", "r_name", 0.6, 4, ["ASIA", "EUROPE", "AFRICA"]).select(F.lit(how).alias("how"), "round", "c_custkey",
        "part") for how in ("holdout", "folds", "leave_one_out")]
    return ways[0].unionByName(ways[1]).unionByName(ways[2])


_BLOCKS = f"""{G}, b AS (SELECT participant, rn // 50 AS run, rn % 50 // 10 AS tr, rn, CASE WHEN participant % 3 > 0 THEN x END AS rx, CASE WHEN
participant % 3 > 0 THEN y END AS ry, CAST(rn % 7 AS DOUBLE) AS tx, y AS ty,
    NOT (rn % 50 // 10 = 2 AND participant % 2 = 0) AS there FROM g),
    f AS (SELECT participant, run, tr, rn, CASE WHEN real THEN rx ELSE tx END AS x, CASE WHEN real THEN ry ELSE ty END AS y, real
      FROM (SELECT *, count(rx) OVER (PARTITION BY participant, run) > 0 AS real FROM b WHERE there))"""


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recorded samples of runs of five TRs: a third of the participants has no measured positions, half of them lack their third TR; and all TRs expected."""
    g = gaze(spark, sf_dir)
    real = F.col("participant") % 3 > 0
    b = g.select("participant", F.expr("rn div 50").alias("run"), F.expr("rn % 50 div 10").alias("tr"), "rn", F.when(real, F.col("x")).alias("rx"),
        F.when(real, F.col("y")).alias("ry"), (F.col("rn") % 7).cast("double").alias("tx"), F.col("y").alias("ty"))
    return b.where("not (tr = 2 and participant % 2 = 0)"), b.select("participant", "run", "tr").distinct()


@query(f"WITH {_BLOCKS} SELECT participant, run, tr, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM f GROUP BY 1, 2, 3")
def label_means(spark, sf_dir):
    """Means by TR of measured positions, or of targets where a run has none."""
    return rounded(labels.tr_means(labels.with_fallback(_blocks(spark, sf_dir)[0])))


@query(f"""WITH {_BLOCKS}, w AS (SELECT *, row_number() OVER (PARTITION BY participant, run, tr ORDER BY rn) - 1 AS i, count(*) OVER (PARTITION BY
participant, run, tr) AS n FROM f),
    e AS (SELECT DISTINCT participant, run, tr FROM b), s AS (SELECT * FROM e, (SELECT unnest(range(0, 4)) AS sub))
    SELECT s.participant, s.run, s.tr, s.sub, round(w.x, 6) AS x, w.y FROM s LEFT JOIN w ON s.participant = w.participant AND s.run = w.run AND s.tr =
    w.tr AND w.i = s.sub * (w.n - 1) // 3""")
def label_fallback(spark, sf_dir):
    """Four samples of each expected TR; one without samples gives four rows of nulls."""
    blocks, expected = _blocks(spark, sf_dir)
    return rounded(labels.per_tr(labels.with_fallback(blocks), expected, 4))


@query(f"""WITH {G}, k AS (SELECT participant, rn, CAST(event_type = 'click' AS INT) AS flag, CAST(event_type <> 'signup' AS INT) AS clock, x, y FROM g),
    r AS (SELECT *, sum(CAST(clock = 0 AS INT)) OVER (PARTITION BY participant ORDER BY rn) AS run FROM k),
    m AS (SELECT *, row_number() OVER (PARTITION BY participant, run ORDER BY rn) - 1 AS i, count(*) OVER (PARTITION BY participant, run) - 1 AS last
    FROM r WHERE clock <> 0),
    a AS (SELECT participant, run, i AS i0, least(i + 7, last) AS i1, row_number() OVER (PARTITION BY participant, run ORDER BY i) - 1 AS tr FROM m WHERE flag = 1)
    SELECT CAST(a.participant AS VARCHAR) AS path, CAST(a.run AS BIGINT) AS run, a.tr, j AS sub, round(m.x, 6) AS x, m.y FROM a, (SELECT unnest(range(0, 4)) AS j)
    JOIN m ON m.participant = a.participant AND m.run = a.run AND m.i = a.i0 + j * (a.i1 - a.i0) // 3""")
def log_samples(spark, sf_dir):
    """Runs and TRs of raw logs, four samples a TR."""
    g = gaze(spark, sf_dir)
    flag, clock = (F.col("event_type") == "click").cast("double"), (F.col("event_type") != "signup").cast("double")
    return rounded(runs_of_log(g.select(F.col("participant").cast("string").alias("participant"), "rn", flag.alias("flag"), clock.alias("clock"), "x", "y"), 7, 4))


@query(f"""WITH {G}, o AS (SELECT participant, rn // 50 AS run, tr % 5 AS tr FROM g GROUP BY ALL), l AS (SELECT participant, run, max(tr) + 1 AS n FROM o GROUP BY 1, 2),
    s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY participant ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
    SELECT o.participant, o.run, CAST(o.tr + before AS BIGINT) AS tr FROM o JOIN s USING (participant, run)""")
def concatenate_runs(spark, sf_dir):
    """The TRs of several runs numbered on."""
    o = gaze(spark, sf_dir).select("participant", F.expr("rn div 50").alias("run"), (F.col("tr") % 5).alias("tr")).distinct()
    return splits.concatenate_runs(o).select("participant", "run", "tr")


_EVALUATION = f"""{V}, w AS (SELECT run AS participant, tr AS vec, row_number() OVER (PARTITION BY run ORDER BY tr) - 1 AS tr FROM (SELECT DISTINCT run, tr FROM v)),
    o AS (SELECT tr AS vec, o, sum(v * (((vox * 7 + o * 3) % 11) - 5) / 10::DOUBLE) AS s FROM v, (SELECT unnest(range(0, 30)) AS o) GROUP BY 1, 2),
    p AS (SELECT w.participant, w.tr, x.o // 2 AS sub, x.s AS px, y.s AS py, abs(u.s) AS unc FROM w JOIN o x ON x.vec = w.vec AND x.o < 20 AND x.o % 2 = 0
      JOIN o y ON y.vec = w.vec AND y.o = x.o + 1 JOIN o u ON u.vec = w.vec AND u.o = 20 + x.o // 2),
    e AS (SELECT user_id % 10 AS participant, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS rn, CASE WHEN event_type <>
    'error' OR event_id % 40 > 0 THEN value END AS x,
      CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events),
    q AS (SELECT p.*, e.x AS tx, e.y AS ty FROM p JOIN e ON e.participant = p.participant AND e.rn // 10 = p.tr AND e.rn % 10 = p.sub)"""


@query(card(_EVALUATION) + " SELECT * FROM card")
def evaluate_participants(spark, sf_dir):
    """A model run over the volumes of ten participants, joined to their labels and scored: predictor, join and scorecard in one job."""
    return rounded(_evaluated(spark, sf_dir)[1])


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    v = packed_volumes(spark, sf_dir)
    tr = (F.row_number().over(Window.partitionBy("run").orderBy("tr")) - 1).cast("long")
    v = v.select(F.col("run").alias("participant"), tr.alias("tr"), "voxels")
    e = read(spark, sf_dir, "events").withColumn("participant", F.col("user_id") % 10)
    rn = (F.row_number().over(Window.partitionBy("participant").orderBy("ts", "event_id")) - 1).cast("long")
    there = (F.col("event_type") != "error") | (F.col("event_id") % 40 > 0)
    e = e.select("participant", rn.alias("rn"), F.when(there, F.col("value")).alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    truth = e.select("participant", F.expr("rn div 10").alias("tr"), F.expr("rn % 10").alias("sub"), "x", "y")
    return predict.evaluate(v, truth, predict.LinearReadout.fixed(64, 30))


@query(f"WITH {_EVALUATION} SELECT participant, tr, sub, round(px, 5) AS px, round(py, 5) AS py, round(unc, 5) AS unc, round(tx, 6) AS tx, ty FROM q")
def evaluation_rows(spark, sf_dir):
    """Predictions beside the truth, as they are written for an evaluation."""
    rows = _evaluated(spark, sf_dir)[0]
    return rows.select("participant", "tr", "sub", *[F.round(c, 5).alias(c) for c in ("px", "py", "unc")], F.round("tx", 6).alias("tx"), "ty")


@query(f"""WITH {PRED}, h AS (SELECT participant, tr, max(tx) AS tx, max(ty) AS ty, max(px) AS px, max(py) AS py FROM q GROUP BY ALL HAVING count(*) =
count(tx) AND count(*) = count(ty))
    SELECT participant, round(avg(sqrt((tx - px) ** 2 + (ty - py) ** 2)), 6) AS e_mean FROM h GROUP BY 1""")
def scorecard_by_hook(spark, sf_dir):
    """The scorecard by TR with another aggregate in place of the median."""
    s = metrics.scorecard(metrics.predict_by_mean(gaze(spark, sf_dir)), functor=F.max)
    return rounded(s.where("variant = 'all' and granularity = 'tr' and e_mean is not null").select("participant", "e_mean"))
