"""Networks: kernels against plain loops, derivatives against differences, tables, training that learns and resumes, and the sizes of real volumes."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetra.operators import batches, network, packed, predict, training


def loop_conv(x, kernel, bias):
    k, out = len(kernel) // 2, np.zeros((*x.shape[:3], kernel.shape[-1]))
    for p in np.ndindex(*x.shape[:3]):
        for d in np.ndindex(*kernel.shape[:3]):
            q = [a + b - k for a, b in zip(p, d)]
            if all(0 <= a < n for a, n in zip(q, x.shape)):
                out[p] += x[tuple(q)] @ kernel[d]
    return out + bias


@pytest.mark.parametrize("k", [1, 3, 5])
def test_convolution_against_loops(k):
    rng = np.random.default_rng(k)
    x, kernel, bias = rng.normal(size=(2, 5, 4, 3, 2)), rng.normal(size=(k, k, k, 2, 3)), rng.normal(size=3)
    y, _ = network._conv({}, {"kernel": kernel, "bias": bias}, None, x)
    for a, b in zip(x, y):
        assert np.allclose(b, loop_conv(a, kernel, bias))


def test_norm_against_slabs():
    x, rng = np.random.default_rng(1).normal(size=(2, 2, 3, 2, 4)), np.random.default_rng(2)
    gamma, beta = rng.normal(size=4), rng.normal(size=4)
    y, _ = network._norm({"groups": 2}, {"gamma": gamma, "beta": beta}, None, x)
    for a, b in zip(x, y):
        flat, want = a.ravel(), []
        for g in range(2):
            s = flat[g * 24 : (g + 1) * 24]
            s = (s - s.mean()) / np.sqrt(s.var() + 1e-5)
            want += [s[i] * gamma[g * 2 + i % 2] + beta[g * 2 + i % 2] for i in range(24)]
        assert np.allclose(b.ravel(), want)


def small(seed=0, kind=np.float64, dropout=0.0):
    return network.Network.fresh(network.gaze_layers(filters=2, depth=3, groups=2, stacks=2, units=4, dropout=dropout), (6, 5, 5), seed, kind)


def test_derivatives_against_differences():
    net, rng = small(1), np.random.default_rng(0)
    x, target = rng.normal(size=(3, 150)), rng.normal(size=(3, 4))

    def total():
        far, miss, _ = training.loss(net.predict(x), target, 0.1)
        return (far + 0.1 * miss).sum()

    out, backs = net.forward(x)
    parts = net.backward(training.loss(out, target, 0.1)[2], backs)
    for name, own in net.weights.items():
        for part, w in own.items():
            for _ in range(2):
                i = tuple(rng.integers(0, n) for n in w.shape)
                before = w[i]
                w[i] = before + 1e-6
                up = total()
                w[i] = before - 1e-6
                down = total()
                w[i] = before
                assert parts[name][part][i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)
    square = network.Network([network.Layer("s", "square", ("input",))], {}, (1, 1, 1), np.float64)
    out, backs = square.forward(np.array([[3.0]]))
    assert out.ravel().tolist() == [9.0] and square.layers[0].op == "square" and backs[0](np.ones((1, 1, 1, 1, 1)))[0][0].ravel().tolist() == [6.0]


def test_tables_hold_the_network(spark, monkeypatch):
    monkeypatch.setattr(network, "CHUNK", 100)
    net = small()
    layers, weights = net.tables(spark)
    assert weights.groupBy("layer", "part").count().agg(F.max("count")).first()[0] > 1
    again = network.Network.from_tables(layers, weights, net.shape, np.float64)
    x = np.random.default_rng(0).normal(size=(2, 150))
    assert (again.predict(x) == net.predict(x)).all() and again.outputs == 6
    monkeypatch.setattr(network, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        network.gathered(weights)


def test_running_a_network(spark):
    net, rng = small(), np.random.default_rng(0)
    rows = [(t, [None if (t, i) == (1, 3) else float(v) for i, v in enumerate(rng.normal(size=150))]) for t in range(20)] + [(99, None)]
    v = spark.createDataFrame(rows, "tr long, voxels array<double>").repartition(3)
    out = {r["tr"]: r["voxels"] for r in network.run(v, net).collect()}
    assert set(out) == set(range(20))
    for t, x in rows[:-1]:
        assert out[t] == pytest.approx(net.predict(np.array([[0.0 if y is None else y for y in x]]))[0].tolist())
    assert network.run(v.where("tr < 0"), net).collect() == []


def test_a_volume_of_real_size_takes_under_a_second():
    net = network.Network.fresh(network.gaze_layers(units=64), (47, 29, 18))
    assert net.outputs == 30
    x = np.random.default_rng(0).normal(size=(1, 47 * 29 * 18))
    took = []
    for _ in range(3):
        t = time.thread_time()
        out = net.predict(x)
        took.append(time.thread_time() - t)
    assert np.isfinite(out).all() and min(took) < 1
    kernel = net.weights["sample0.dense0"]["kernel"]
    assert kernel.shape == (5 * 3 * 2 * 256, 64)  # three times halved, odd ends dropped


def samples(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(8, 4)) / 3
    rows = []
    for i in range(n):
        x = rng.normal(size=8)
        y = x @ w + (i % 2) * rng.normal(size=4)
        rows.append((i, x.tolist(), y.tolist()))
    return spark.createDataFrame(rows, "tr long, voxels array<double>, target array<double>")


LAYERS = [*network.chain(("flatten", {}), ("dense", {"units": 16}), ("mish", {})), network.Layer("position", "dense", ("mish2",), {"units": 4}), *network.chain(("dense", {"units": 2}), ("mish", {}), start="mish2", prefix="c."),
    network.Layer("out", "join", ("position", "c.mish1"))]


def test_training_learns_position_and_error_and_resumes(spark, tmp_path):
    net = network.Network.fresh(LAYERS, (2, 2, 2), 3, np.float64)
    recipe = training.Recipe(rate=0.02, epochs=15, steps=2)
    dealt = training.deal(samples(spark), 2, str(tmp_path / "a"))
    assert dealt.where("step = 0").count() > 60
    trained, history = training.train(dealt, net, recipe, str(tmp_path / "a"))
    h = history.orderBy("step").collect()
    assert [r["step"] for r in h] == list(range(30)) and sum(r["n"] for r in h) == 15 * 240
    assert h[-1]["distance"] < 0.7 * h[0]["distance"]
    x = np.stack([r["voxels"] for r in dealt.collect()])
    assert abs(trained.predict(x)[:, 4:]).mean() > 0.1  # the error is learned
    part, _ = training.train(dealt, net, recipe, str(tmp_path / "b"), until=7)
    assert training.resumed(spark, str(tmp_path / "b"))[0] == 7
    again, _ = training.train(dealt, net, recipe, str(tmp_path / "b"))
    assert np.allclose(again.predict(x), trained.predict(x), atol=1e-6) and not np.allclose(part.predict(x), trained.predict(x), atol=1e-3)
    assert len(training._done(spark, str(tmp_path / "b"))) == 2


def test_a_step_equals_one_in_numpy_whatever_the_partitions(spark):
    net, data = network.Network.fresh(LAYERS, (2, 2, 2), 1, np.float64), samples(spark, 30)
    hole = spark.createDataFrame([(100, [1.0] * 8, [1.0, None, 1.0, 1.0]), (101, [1.0] * 8, None), (102, None, [1.0] * 4)], data.schema)
    rows = data.collect()
    x, y = (np.array([r[c] for r in rows]) for c in ("voxels", "target"))
    out, backs = net.forward(x)
    want = net.backward(training.loss(out, y, 0.1)[2], backs)
    for parts in (1, 5):
        state = training.updated(training.started(spark, net), training.gradients(data.unionByName(hole).repartition(parts), net, training.Recipe(), 0), 0, 0.01)
        new = training.current(state, net)
        for name, own in want.items():
            for part, g in own.items():
                g = g / 30
                assert np.allclose(new.weights[name][part], net.weights[name][part] - 0.01 * g / (abs(g) + 1e-7 / np.sqrt(0.001)), atol=1e-6)
    same = training.updated(training.started(spark, net), training.gradients(hole, net, training.Recipe(), 0), 0, 0.01)
    assert np.allclose(training.current(same, net).predict(x), net.predict(x)) and training.losses(same).count() == 0


def test_dropout_and_augmentation_depend_on_key_and_step_alone(spark):
    net = small(dropout=0.3)
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=150).tolist(), [1.0, 2.0, 3.0, 4.0]) for i in range(8)], "tr long, voxels array<double>, target array<double>")
    recipe = training.Recipe(rotation=5, shift=1, zoom=10)
    sums = lambda df, step: {(r["layer"], r["part"]): np.array(r["values"]) for r in training.gradients(df, net, recipe, step).groupBy("layer", "part").agg(F.first("values").alias("values")).collect()}
    a, b, c = sums(rows.coalesce(1), 3), sums(rows.orderBy(F.desc("tr")).coalesce(1), 3), sums(rows.coalesce(1), 4)
    assert all(np.allclose(a[k], b[k], atol=1e-9) for k in a) and not np.allclose(a["", "loss"], c["", "loss"])


def test_batches_equal_expressions(spark):
    rng, shape = np.random.default_rng(5), (5, 4, 3)
    v = spark.createDataFrame([(i, rng.normal(size=60).tolist()) for i in range(12)], "tr long, voxels array<double>")
    got = lambda df: {r["tr"]: r["voxels"] for r in df.collect()}
    a, b = got(batches.augment(v, shape, 25, 1, 30)), got(packed.augment(v, shape, 25, 1, 30))
    assert all(a[k] == pytest.approx(b[k]) for k in a) and len(a) == 12
    moved = v.withColumns({"dx": F.lit(1), "dy": F.lit(-1), "dz": F.col("tr") % 2})
    a, b = got(batches.shift(moved, shape)), got(moved.withColumn("voxels", packed.shift(F.col("voxels"), shape, F.col("dx"), F.col("dy"), F.col("dz"))))
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_fit_by_steps_equals_the_solved_equations(spark, monkeypatch):
    data = samples(spark, 120)
    a = predict.fit(data, 8, 4, 2.0)
    monkeypatch.setattr(predict, "MOST_PRODUCTS", 0)
    b = predict.fit(data.repartition(3), 8, 4, 2.0)
    assert np.allclose(a.weights, b.weights, atol=1e-6) and np.allclose(a.bias, b.bias, atol=1e-6)
    none = predict.fit(data.where("tr < 0"), 8, 4)
    assert none.weights.shape == (8, 4) and not none.weights.any()


def test_fit_at_the_size_of_real_eyes(spark):
    """24,534 voxels: what a task sends has the size of the model, 24,535 x 20 numbers."""
    n, rng = 47 * 29 * 18, np.random.default_rng(0)
    base = rng.normal(size=(6, n)).astype(np.float32)
    mix = rng.normal(size=(60, 6))
    rows = [(i, (m @ base).tolist(), (m @ rng.normal(size=(6, 1)) * np.ones(20)).tolist()) for i, m in enumerate(mix)]
    data = spark.createDataFrame(rows, "tr long, voxels array<float>, target array<double>").repartition(4)
    model = predict.fit(data, n, 20, steps=15)
    assert model.weights.shape == (n, 20)
    x, y = mix @ base, np.array([r[2] for r in rows])
    d = np.hstack([x, np.ones((60, 1))])
    dual = d.T @ np.linalg.solve(d @ d.T + np.eye(60), y)  # the constant pulled too, which hardly matters here
    assert np.abs(model.predict(x) - d @ dual).max() < 0.05 * np.abs(y).max()


@pytest.mark.parametrize("way,rounds", [("holdout", ["0"]), ("leave_one_out", ["1", "2", "3"])])
def test_training_entry_point(spark, tmp_path, way, rounds):
    from volumetra.__main__ import main

    rng = np.random.default_rng(2)
    volumes = [(d, d * 10 + p, t, [2, 2, 2], rng.normal(size=8).tolist()) for d in (1, 2, 3) for p in range(3) for t in range(8)]
    labels = [(p, t, s, v[s], v[s + 1]) for _, p, t, _, v in volumes for s in range(2)]
    spark.createDataFrame(volumes, "dataset long, participant long, tr long, dims array<int>, voxels array<double>").write.parquet(str(tmp_path / "volumes"))
    spark.createDataFrame(labels, "participant long, tr long, sub long, x double, y double").write.parquet(str(tmp_path / "labels"))
    small = "--filters 2 --depth 1 --units 4 --dense 1 --groups 2 --epochs 2 --steps 2 --rate 0.01 --rotation 0 --shift 0 --zoom 0" if way == "holdout" else ""
    main([str(tmp_path), "--way", way, "--subsamples", "2", *(["--model", "network", *small.split()] if small else [])])
    for r in rounds:
        assert spark.read.parquet(str(tmp_path / "scores" / r)).count() > 0 and spark.read.parquet(str(tmp_path / "evaluation" / r)).count() > 0
    if small:
        assert {"layer", "part", "values"} <= set(spark.read.parquet(str(tmp_path / "weights" / "0")).columns)
