"""Every query with SQL against DuckDB, small models in NumPy for what is easy to get wrong, and the edge cases of missing values."""

import os

import duckdb
import numpy as np
import pytest

from volumetra.functions import scalars
from volumetra.operators import metrics, series, volume
from volumetra.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    one = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else v
    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    want = plain(con.execute(f"select {', '.join(columns)} from ({catalogue.ORACLES[name]})").fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-5)


def test_smoothing_pads_in_order(spark):
    y = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0]
    g = spark.createDataFrame([(1, i, v) for i, v in enumerate(y)], "participant long, rn long, y double")
    for n in (2, 3, 4, 5):
        padded = np.array(y[:n] + y + y[-n:])
        want = [padded[n + i - n // 2 : n + i + (n - 1) // 2 + 1].mean() for i in range(len(y))]
        got = [r["y"] for r in series.smooth(g, n).orderBy("rn").collect()]
        assert got == pytest.approx(want)


def test_normalisation_against_numpy(spark):
    v = np.random.default_rng(1).normal(size=(12, 8))
    rows = [(1, t, k, float(v[t, k])) for t in range(12) for k in range(8)]
    out = volume.normalize(spark.createDataFrame(rows, "run long, tr long, vox long, v double"), zero=0.0).collect()
    z = (v - v.mean(0)) / v.std(0)
    z = (z - z.mean(1, keepdims=True)) / z.std(1, keepdims=True)
    z = np.clip(z, -5 * z.std(), 5 * z.std())
    assert all(r["v"] == pytest.approx(z[r["tr"], r["vox"]]) for r in out)


def test_labels_have_the_known_shape_and_range(spark):
    points = spark.createDataFrame([(i, 0.95 * (1 - 2 * (i % 2)), 0.9) for i in range(27)], "i long, px double, py double")
    out = series.expand_labels(points).toPandas()
    assert len(out) == 135 * 10 and abs(out["x"]).max() == pytest.approx(9.5)
    assert out["y"].iloc[0] == pytest.approx(-14.7 * 0.9 / 1.9)


def test_scores_of_awkward_participants(spark):
    rows = [("constant", 0, i, 1.0, 2.0, 1.0, 2.0, 0.1) for i in range(5)] + [("missing", 0, i, None, 2.0, 1.0, 2.0, 0.1) for i in range(5)] + [("single", 0, 0, 1.0, 2.0, 1.5, 2.0, 0.1)]
    p = spark.createDataFrame(rows, "participant string, tr long, sub long, tx double, ty double, px double, py double, unc double")
    out = {(r["participant"], r["granularity"]): r for r in metrics.scorecard(p).where("variant = 'all'").collect()}
    assert out["constant", "subtr"]["r_x"] is None and out["constant", "subtr"]["r2_x"] == 1.0
    assert out["missing", "subtr"]["e_mean"] is None and out["missing", "tr"]["r2_x"] is None
    assert out["single", "subtr"]["r2_x"] is None and out["single", "subtr"]["e_mean"] == 0.5


def test_short_series_repeat_samples(spark):
    g = spark.createDataFrame([(1, i, float(i)) for i in range(3)], "participant long, rn long, x double")
    got = [r["rn"] for r in series.resample(g, 10).orderBy("j").collect()]
    assert got == [int(x) for x in np.linspace(0, 2, 10)]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None, 5.0), (7.0, 5.0), (-7.0, 5.0), (1.0, 5.0)], "v double, b double")
    assert [r[0] for r in df.select(scalars.clip(df["v"], df["b"])).collect()] == [None, 5.0, -5.0, 1.0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name, exchanges", [("gaze_scorecard", 1), ("pad_grid", 0), ("shift_fill", 0), ("zoom_enlarge", 0), ("rotate_nearest", 0), ("conv_small", 0), ("residual_block", 0), ("augment_each", 0), ("group_norm", 0), ("ffill_trace", 1), ("within_subject_split", 1)])
def test_exchanges_of_plans(spark, name, exchanges):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange ") == exchanges, plan


def test_no_window_over_a_whole_run_or_all_participants(spark):
    import re

    v = spark.createDataFrame([(1, 1, 1, 1.0)], "run long, tr long, vox long, v double")
    plan = volume.normalize(v)._jdf.queryExecution().executedPlan().toString()
    assert not any(re.search(r"Window.*\[run#\d+L?\]$", line) for line in plan.splitlines())


def test_folds_have_the_sizes_of_an_even_split(spark):
    from volumetra.operators import splits

    for n, k in ((23, 5), (5, 5), (3, 5), (100, 7)):
        units = spark.range(n).withColumnRenamed("id", "u")
        sizes = sorted(r["count"] for r in splits.folds(units, "u", k).where("part = 'test'").groupBy("fold").count().collect())
        assert sizes == sorted(len(x) for x in np.array_split(np.arange(n), k) if len(x))


def test_sides_of_a_split(spark):
    from volumetra.operators import splits

    units = spark.createDataFrame([(i, f"d{i % 3}") for i in range(30)], "u long, d string")
    parts = splits.split(units, "leave_one_out", "u", "d")
    train, test = splits.sides(units.withColumn("x", units["u"]), parts, "d1", "u")
    assert {r["d"] for r in test.collect()} == {"d1"} and train.count() == 20
    assert splits.subset(units, "d", ["d0"]).count() == splits.subset(units, "d", units.where("u = 0").select("d")).count() == 10
    with pytest.raises(ValueError):
        splits.split(units, "by moon", "u", "d")


def test_spacing_that_is_too_close_fails(spark):
    g = spark.createDataFrame([(1, i, i in (0, 5, 8)) for i in range(12)], "participant long, rn long, flag boolean")
    assert series.require_spacing(g, "flag", 3).count() == 12
    with pytest.raises(Exception, match="closer than expected"):
        series.require_spacing(g, "flag", 4).collect()


def test_labels_of_one_subject_and_names(spark):
    from volumetra.operators import labels, splits

    s = spark.createDataFrame([(1, 0, 0, 0, None, None, 2.0, 3.0), (12, 0, 0, 0, 1.0, 1.0, 2.0, 3.0)], "participant long, run long, tr long, rn long, rx double, ry double, tx double, ty double")
    assert labels.subject(s, "12").count() == 1
    rows = {r["participant"]: (r["x"], r["real"]) for r in labels.with_fallback(s).collect()}
    assert rows == {1: (2.0, False), 12: (1.0, True)} and labels.with_fallback(s, use_real=False).where("real").count() == 0
    paths = spark.createDataFrame([("/a/b/participant01.nii.gz",)], "path string")
    assert splits.names(paths).first()["name"] == "ipant01"


def test_options():
    from volumetra.options import Options

    assert Options.from_args(["--epochs", "3", "--share", "0.9"]) == Options(epochs=3, share=0.9)
