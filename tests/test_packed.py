"""Packed volumes against NumPy, and plans that must not deal volumes anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetra.operators import packed, predict, register, volume

SHAPE = (3, 4, 5)


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(0).normal(size=SHAPE)


@pytest.fixture(scope="module")
def one(spark, cube):
    df = spark.createDataFrame([(7, cube.ravel().tolist())], "tr long, voxels array<double>")
    return lambda column: np.array(df.select(column.alias("out")).first()[0], dtype=float)


def test_places(one, cube):
    assert np.allclose(one(packed.pad(F.col("voxels"), SHAPE, 1)), np.pad(cube, 1).ravel())
    assert np.allclose(one(packed.crop(F.col("voxels"), SHAPE, (1, 0, 2), (3, 2, 5))), cube[1:3, 0:2, 2:5].ravel())
    moved = np.zeros(SHAPE)
    moved[1:, :-1, :] = cube[:-1, 1:, :]
    assert np.allclose(one(packed.shift(F.col("voxels"), SHAPE, 1, -1, 0)), moved.ravel())
    assert np.allclose(one(packed.stack(F.col("voxels"), F.col("voxels"))), np.concatenate([cube, cube]).ravel())
    assert np.allclose(one(packed.upsample(F.col("voxels"), SHAPE)), cube.repeat(2, 0).repeat(2, 1).repeat(2, 2).ravel())
    assert np.allclose(one(packed.pool(F.col("voxels"), SHAPE)), cube[:2, :4, :4].reshape(1, 2, 2, 2, 2, 2).mean(axis=(1, 3, 5)).ravel())


def test_turns_and_zooms(one, cube):
    assert np.allclose(one(packed.rotate(F.col("voxels"), SHAPE, 0, 0)), cube.ravel()) and np.allclose(one(packed.zoom(F.col("voxels"), SHAPE, 1.0)), cube.ravel())
    assert np.allclose(one(packed.rotate(F.col("voxels"), SHAPE, 180, 0)), cube[:, ::-1, ::-1].ravel())
    assert np.allclose(one(packed.rotate(F.col("voxels"), SHAPE, 360, 1)), cube.ravel())
    small = one(packed.zoom(F.col("voxels"), SHAPE, 0.5)).reshape(SHAPE)
    assert small[1, 1, 2] != 0 and small[0, 0, 0] == small[2, 3, 4] == 0


def test_kernels(one, cube):
    w = np.random.default_rng(1).normal(size=(2, 27))
    channels = [cube, cube**2]
    want = np.full(SHAPE, 0.5)
    for c, k in zip(channels, w.reshape(2, 3, 3, 3)):
        p = np.pad(c, 1)
        want += sum(k[a, b, d] * p[a : a + 3, b : b + 4, d : d + 5] for a in range(3) for b in range(3) for d in range(3))
    assert np.allclose(one(packed.convolve([F.col("voxels"), F.transform(F.col("voxels"), lambda v: v * v)], SHAPE, w, 0.5)), want.ravel())
    g = cube.ravel().reshape(4, 15)
    normed = (g - g.mean(1, keepdims=True)) / np.sqrt(g.var(1, keepdims=True) + 1e-5)
    assert np.allclose(one(packed.group_norm(F.col("voxels"), 60, 4)), normed.ravel())
    assert np.allclose(one(packed.group_norm(F.col("voxels"), 60, 4, [1, 2, 3, 4], [0, 1, 0, 1])), (normed * np.array([[1], [2], [3], [4]]) + np.array([[0], [1], [0], [1]])).ravel())
    assert np.allclose(one(packed.dense(F.col("voxels"), np.ones((2, 60)), [1, 2])), [cube.sum() + 1, cube.sum() + 2])
    step = packed.activate(packed.group_norm(packed.convolve([F.col("voxels")], SHAPE, [w[0]]), 60, 4))
    assert np.allclose(one(packed.downsample(F.col("voxels"), SHAPE, w[0], 4)), one(packed.pool(step, SHAPE)))
    assert one(packed.with_channel(F.col("voxels"))).shape == (60, 1)


def test_nulls_stay_and_unknown_places_are_filled(spark):
    df = spark.createDataFrame([(1, [None, 2.0, 3.0, 4.0])], "tr long, voxels array<double>")
    assert df.select(packed.shift(F.col("voxels"), (4, 1, 1), 1, 0, 0, -1.0)).first()[0] == [-1.0, None, 2.0, 3.0]


def test_augmentation_is_drawn_from_the_key(spark, cube):
    df = spark.createDataFrame([(t, cube.ravel().tolist()) for t in range(30)], "tr long, voxels array<double>")
    rows = {r["tr"]: r["voxels"] for r in packed.augment(df, SHAPE, 30, 1, 40).collect()}
    again = {r["tr"]: r["voxels"] for r in packed.augment(df.repartition(4), SHAPE, 30, 1, 40).collect()}
    assert rows == again and len({tuple(v) for v in rows.values()}) > 20
    assert packed.augment(df, SHAPE).first()["voxels"] == df.first()["voxels"]


def test_packing_and_long_form(spark, cube):
    df = spark.createDataFrame([(t, (cube + t).ravel().tolist()) for t in range(3)], "tr long, voxels array<double>")
    back = {r["tr"]: r["voxels"] for r in packed.pack(packed.long_form(df, SHAPE), SHAPE).collect()}
    assert all(np.allclose(back[t], (cube + t).ravel()) for t in range(3))


def test_volumes_are_not_dealt_anew(spark, cube):
    df = spark.createDataFrame([(t, cube.ravel().tolist()) for t in range(3)], "tr long, voxels array<double>")
    made = packed.augment(df, SHAPE, 10, 1, 10).withColumn("voxels", packed.convolve([F.col("voxels")], SHAPE, [[1.0] * 27])).withColumn("voxels", packed.pool(F.col("voxels"), SHAPE))
    plan = packed.long_form(made, (1, 2, 2))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_edges_of_masks(spark):
    mask = spark.createDataFrame([(x, y, 2) for x in (1, 2, 5, 6, 9, 11) for y in (0, 3)], "x long, y long, z long")
    e = volume.edges(mask).first()
    assert (e["x_min"], e["x_max"], e["y_max"], e["z_min"], e["mid"], e["gap_mid"]) == (1, 11, 3, 2, 6, 3)
    alone = volume.edges(spark.createDataFrame([(4, 1, 1)], "x long, y long, z long")).first()
    assert alone["gap_mid"] is None and alone["mid"] == 4


def test_cut_eyes_has_the_shape_of_both_halves(spark):
    mask = spark.createDataFrame([(x, y, z) for x in (0, 1, 2, 6, 7, 8, 9) for y in range(3) for z in range(3)], "x long, y long, z long")
    g = spark.createDataFrame([(0, x, y, z, float(x)) for x in range(10) for y in range(4) for z in range(4)], "tr long, x long, y long, z long, v double")
    out = {(r["x"], r["y"], r["z"]): r["v"] for r in volume.cut_eyes(g, mask).collect()}
    assert sorted({k[0] for k in out}) == list(range(9)) and len(out) == 9 * 2 * 2
    # the gap from 2 to 6 parts the eyes at 4: the right half first, planes of the gap are 0
    assert [out[x, 0, 0] for x in range(9)] == [0.0, 0.0, 6.0, 7.0, 8.0, 0.0, 1.0, 2.0, 0.0]


def test_fitted_readout(spark, tmp_path):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(300, 6)), rng.normal(size=(6, 2))
    y = x @ w + [1.0, -2.0]
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))] + [(999, [1.0] * 6, [None, 1.0])]
    df = spark.createDataFrame(rows, "tr long, voxels array<double>, target array<double>").repartition(5)
    model = predict.fit(df, 6, 2, ridge=1e-9)
    assert np.allclose(model.weights, w, atol=1e-6) and np.allclose(model.bias, [1, -2], atol=1e-6)
    model.save(spark, str(tmp_path / "weights"))
    again = predict.LinearReadout.load(spark, str(tmp_path / "weights"))
    out = predict.run(df, again).toPandas().sort_values("tr")
    assert np.allclose(out[["p0", "p1"]].to_numpy()[:300], y)


def test_evaluation_is_written_by_participant(spark, tmp_path):
    volumes = spark.createDataFrame([(p, t, [float(p), float(t)]) for p in (1, 2) for t in range(6)], "participant long, tr long, voxels array<double>")
    truth = spark.createDataFrame([(1, t, s, float(t), float(s)) for t in range(6) for s in range(2)], "participant long, tr long, sub long, x double, y double")
    both, card = predict.evaluate(volumes, truth, predict.LinearReadout(np.ones((2, 6))), subs=2)
    assert both.count() == 12 and card.select("participant").distinct().count() == 1
    predict.write_evaluation(both, str(tmp_path / "evaluation"))
    assert spark.read.parquet(str(tmp_path / "evaluation")).where("participant = 1").count() == 12


def test_registration_moves_the_centre_onto_the_template(spark):
    def blob(x, y):
        v = np.zeros((6, 6, 3))
        v[x : x + 2, y : y + 2, 1] = 1
        return v.ravel().tolist()

    rows = [(1, t, blob(0, 1)) for t in range(4)] + [(2, t, blob(3, 3)) for t in range(4)] + [(3, 0, [0.0] * 108)]
    volumes = spark.createDataFrame(rows, "run long, tr long, voxels array<double>")
    template = spark.createDataFrame([(blob(2, 2),)], "voxels array<double>")
    moved = register.by_centre(volumes, template, (6, 6, 3), passes=(None, None))
    out = {(r["run"], r["tr"]): r["voxels"] for r in moved.collect()}
    assert all(out[k, t] == blob(2, 2) for k in (1, 2) for t in range(4)) and sum(out[3, 0]) == 0
    stats = register.statistics(register.shifts(volumes, template, (6, 6, 3))).first()
    assert stats["total"] == pytest.approx(5**0.5 + 2**0.5)


def test_training_and_scoring(spark):
    from volumetra.__main__ import train_and_score
    from volumetra.options import Options

    rng = np.random.default_rng(2)
    w = rng.normal(size=(8, 4))
    volumes, labels = [], []
    for p in range(10):
        for t in range(30):
            v = rng.normal(size=8)
            volumes.append((p, t, v.tolist()))
            labels += [(p, t, s, float(v @ w[:, 2 * s]), float(v @ w[:, 2 * s + 1])) for s in range(2)]
    v = spark.createDataFrame(volumes, "participant long, tr long, voxels array<double>")
    y = spark.createDataFrame(labels, "participant long, tr long, sub long, x double, y double")
    _, both, scores = train_and_score(spark, v, y, Options(subsamples=2, ridge=1e-6))
    card = scores.where("variant = 'all' and granularity = 'subtr'").collect()
    assert len(card) == 4 and all(r["r2_x"] > 0.99 and r["r_y"] > 0.99 for r in card) and both.count() == 4 * 30 * 2
