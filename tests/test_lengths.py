"""Groups of any size: exact order statistics by refinement, running operations over spans, and the hook for aggregates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetra.operators import exact, metrics, series, spans, volume


def draws(kind, rng):
    return {"uniform": rng.random(3000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.full(700, 2.5), "wide": rng.choice([-1, 1], 2000) * 10.0 ** rng.uniform(-300, 300, 2000),
        "tail": np.append(rng.random(2000), [1e308, -1e308]), "two": np.array([3.0, 5.0]), "few": np.array([1.0])}[kind]


KINDS = ["uniform", "ties", "one", "wide", "tail", "two", "few"]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    data = {k: draws(k, rng) for k in KINDS}
    rows = [(k, float(v)) for k, own in data.items() for v in own] + [("uniform", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.8, 1.0]
    got = {(r["k"], r["share"]): r["value"] for r in exact.quantiles(df, ["k"], "v", shares, bins=16, enough=8).collect()}
    assert set(got) == {(k, s) for k in KINDS for s in shares}
    for k, own in data.items():
        s = np.sort(own)
        for share in shares:
            p = share * (len(s) - 1)
            lo, hi = s[int(np.floor(p))], s[int(np.ceil(p))]
            assert got[k, share] == pytest.approx(lo + (p - np.floor(p)) * (hi - lo), rel=1e-12)


def test_refinement_holds_bins_or_a_few_values(spark, monkeypatch):
    """Whatever a group's size, what is gathered for it is ``bins`` counts or ``enough`` values."""
    most = []
    real = exact.stored

    def watched(df):
        out = real(df)
        if {"below", "n"} <= set(out.columns):
            most.append(out.agg(F.max("n")).first()[0])
        return out

    monkeypatch.setattr(exact, "stored", watched)
    df = spark.range(50_000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").cast("double").alias("v"))
    exact.quantiles(df, ["k"], "v", [0.5], bins=32, enough=20).collect()
    assert most[0] == 25_000 and most[-1] <= 20 and all(b < a for a, b in zip(most, most[1:]))


def test_robust_scores_equal_windows(spark):
    rng = np.random.default_rng(1)
    rows = [(1, t, v, None if rng.random() < 0.1 else float(x)) for v in range(3) for t, x in enumerate(rng.normal(size=40).round(1 if v else 3))]
    df = spark.createDataFrame(rows, "run long, tr long, vox long, v double")
    a, b = ({(r["tr"], r["vox"]): r["v"] for r in volume.normalize(df, True, refined=x).collect()} for x in (False, True))
    assert a == pytest.approx(b)


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(3)
    rows = [(p, int(t), None if rng.random() < 0.7 else float(t), float(rng.random()), bool(rng.random() < 0.05)) for p, n in ((1, 3000), (2, 6), (3, 401)) for t in rng.permutation(n)]
    return spark.createDataFrame(rows, "participant long, at long, x double, y double, flag boolean").repartition(4)


def test_numbering_by_ranges(signal):
    out = spans.numbered(signal, ["at"], 6)
    assert all(r["rn"] == r["at"] for r in out.select("rn", "at").collect())


@pytest.mark.parametrize("span", [7, 100, 10**6])
def test_spans_equal_windows(signal, span):
    g = signal.withColumn("rn", F.col("at"))
    same = lambda a, b, *c: assert_equal(a.select(*c), b.select(*c))
    same(spans.forward_fill(g, span), series.forward_fill(g), "participant", "rn", "x")
    same(spans.segments(g, "flag", span), series.segments(g, "flag"), "participant", "run", "n", "first", "last")
    for n in (1, 4, 5):
        same(spans.smooth(g, n, span), series.smooth(g, n), "participant", "rn", F.round("y", 9).alias("y"))


def assert_equal(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_no_task_gets_a_whole_participant(spark, signal):
    """One participant with nearly all samples: the rows that windows get are dealt to many tasks."""
    one = signal.where("participant = 1").withColumn("rn", F.col("at"))
    filled = spans.forward_fill(one, 100).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert filled.groupBy("task").count().agg(F.max("count")).first()[0] < 2500
        ranges = spans.numbered(signal.where("participant = 1"), ["at"], 8).withColumn("task", F.spark_partition_id())
        assert ranges.groupBy("task").count().agg(F.max("count")).first()[0] < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(ValueError):
        spans.smooth(one, 10, 5)


def test_a_hook_in_sql(spark):
    metrics.register_hook(spark, "trimmed_mean", metrics.trimmed_mean)
    rows = [(1, 0, v) for v in (5.0, 1.0, 3.0, 100.0)] + [(1, 1, 2.0), (1, 1, None), (2, 0, 7.0), (2, 0, 9.0)]
    df = spark.createDataFrame(rows, "participant long, tr long, v double")
    df.createOrReplaceTempView("hooked")
    got = spark.sql("SELECT participant, tr, trimmed_mean(v) AS v FROM hooked GROUP BY participant, tr").collect()
    assert {(r["participant"], r["tr"]): r["v"] for r in got} == {(1, 0): 4.0, (1, 1): None, (2, 0): 8.0}
    p = df.select("participant", "tr", *[F.col("v").alias(c) for c in metrics.VALUES])
    assert {(r["participant"], r["tr"]): r["px"] for r in metrics.by_tr_hook(p, "trimmed_mean").collect()}[1, 0] == 4.0
