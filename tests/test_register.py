"""Similarity registration: drawn transforms are found again, passes and masks, statistics, and images of real size."""

import time

import numpy as np
import pytest

from volumetra.operators import packed, preprocess, register, volume

BLOBS = [((14, 18, 15), 4.0, 1.0), ((26, 18, 15), 4.0, 1.0), ((20, 10, 18), 6.0, 0.5), ((20, 26, 10), 5.0, 0.7), ((12, 28, 20), 3.0, 0.8)]


def phantom(points, scale=1.0):
    return sum(a * np.exp(-(((points - np.array(c) * scale) / (w * scale)) ** 2).sum(-1) / 2) for c, w, a in BLOBS)


def grid(shape):
    return np.indices(shape).transpose(1, 2, 3, 0).astype(float)


def moved(shape, m, scale=1.0):
    """The image that ``m`` brings onto the phantom."""
    inverse = np.linalg.inv(np.vstack([m, [0, 0, 0, 1]]))
    return phantom(grid(shape) @ inverse[:3, :3].T + inverse[:3, 3], scale)


DRAWN = [np.array(p) for p in ([0.15, -0.1, 0.2, np.log(1.1), 2.0, -1.5, 1.0], [-0.1, 0.12, -0.15, np.log(0.92), -1.0, 2.0, -2.0], [0.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0])]


def test_drawn_transforms_are_found(spark):
    shape, template = (40, 36, 30), phantom(grid((40, 36, 30)))
    rng, rows = np.random.default_rng(0), []
    for run, p in enumerate(DRAWN):
        image = moved(shape, register.matrix(p, shape))
        rows += [(run, t, (3 * image + 10 + 0.02 * rng.normal(size=shape)).ravel().tolist()) for t in range(3)]
    volumes = spark.createDataFrame(rows, "run long, tr long, voxels array<double>").repartition(4)
    mask = template > 0.05
    out, transforms = register.by_similarity(volumes, template.ravel(), shape, masks=(None, mask, mask))
    got = transforms.collect()
    assert len(got) == 9
    for r in got:
        want = register.matrix(DRAWN[r["run"]], shape)
        m = np.array(r["matrix"]).reshape(3, 4)
        assert np.abs(m[:, :3] - want[:, :3]).max() < 0.01 and np.abs((m - want) @ [20, 18, 15, 1]).max() < 0.1
        assert r["correlation"] > 0.95
    for r in out.collect():
        v = np.array(r["voxels"])
        shown = mask.ravel() & (v > 9)  # 0 where the image has nothing
        assert shown.sum() > 0.8 * mask.sum() and np.corrcoef(v[shown], template.ravel()[shown])[0, 1] > 0.97
    stats = {(r["run"], r["pass"]): r for r in register.transform_statistics(transforms).collect()}
    for r in got:
        s, m = stats[r["run"], r["pass"]], np.array(r["matrix"])
        assert (s["total"], s["mean"], s["std"], s["median"]) == pytest.approx((m.sum(), m.mean(), m.std(), np.median(m)))


def test_trilinear_values_and_slopes():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(4, 3, 5))
    p = np.array([[1.25, 0.5, 3.75], [0, 0, 0], [2, 1, 3], [-2, 0, 0], [3, 2, 4]], float)
    got, slopes = register.sampled(v, p, True)
    want = sum(v[1 + i, j, 3 + k] * (0.25 if i else 0.75) * 0.5 * (0.75 if k else 0.25) for i, j, k in np.ndindex(2, 2, 2))
    assert got == pytest.approx([want, v[0, 0, 0], v[2, 1, 3], 0, v[3, 2, 4]])
    e = 1e-6
    for k in range(3):
        q = p[:1].copy()
        q[0, k] += e
        assert slopes[0, k] == pytest.approx(((register.sampled(v, q) - got[:1]) / e)[0], abs=1e-4)


def test_awkward_runs(spark):
    """Runs without contrast or volumes, missing voxels, and volumes that are null."""
    shape, flat = (8, 8, 8), phantom(grid((8, 8, 8)) * 5)
    rows = [(1, 0, [0.0] * 512), (2, 0, [None] * 512), (3, 0, None), (4, 0, flat.ravel().tolist())]
    v = spark.createDataFrame(rows, "run long, tr long, voxels array<double>")
    out, transforms = register.by_similarity(v, flat.ravel(), shape)
    t = {r["run"]: r for r in transforms.collect()}
    assert set(t) == {1, 2, 4} and t[1]["correlation"] == 0 and t[4]["correlation"] > 0.999
    assert len(out.collect()) == 3
    assert register.similarity(v.where("run > 9"), flat.ravel(), shape).collect() == []


def test_transforms_beyond_the_bound_are_joined(spark, monkeypatch):
    shape = (4, 4, 4)
    v = spark.createDataFrame([(r, t, np.arange(64.0).tolist()) for r in range(5) for t in range(3)], "run long, tr long, voxels array<double>")
    m = spark.createDataFrame([(r, register.matrix(np.array([0, 0, 0, 0, r - 2, 0, 0.5]), shape).ravel().tolist()) for r in range(5)], "run long, matrix array<double>")
    got = lambda: sorted(map(tuple, register.resample(v, m, shape).collect()))
    few = got()
    monkeypatch.setattr(register, "MOST_RUNS", 2)
    assert got() == few and len(few) == 15


def test_pack_fills_holes(spark):
    rows = [(1, 0, 0, 0, 5.0), (1, 1, 1, 1, None), (1, 1, 0, 1, 7.0), (2, 0, 1, 1, 2.0)]
    g = spark.createDataFrame(rows, "tr long, x long, y long, z long, v double")
    out = {r["tr"]: r["voxels"] for r in packed.pack(g, (2, 2, 2), fill=-1.0).collect()}
    assert out == {1: [5.0, -1, -1, -1, -1, 7.0, -1, -1], 2: [-1, -1, -1, 2.0, -1, -1, -1, -1]}


def test_packing_real_eyes_is_linear(spark):
    shape = (47, 29, 18)
    g = spark.range(4 * packed.size(shape)).selectExpr("id % 4 AS tr", "id div 4 AS i", "CAST(id AS double) AS v")
    grid_ = g.select("tr", *[p.alias(c) for c, p in zip("xyz", packed.place(g["i"], shape))], "v")
    t = time.time()
    out = packed.pack(grid_, shape).collect()
    assert time.time() - t < 60 and all(r["voxels"][:2] == [r["tr"], 4.0 + r["tr"]] and len(r["voxels"]) == packed.size(shape) for r in out)


def test_eyes_cut_as_in_long_form(spark):
    rng = np.random.default_rng(1)
    shape, inside = (9, 4, 3), np.random.default_rng(2).random((9, 4, 3)) > 0.4
    inside[4:6] = False
    v = rng.normal(size=(3, *shape))
    mask = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(inside)], "x long, y long, z long")
    at, box = preprocess.places(mask, shape)
    from volumetra.operators import batches

    volumes = spark.createDataFrame([(t, v[t].ravel().tolist()) for t in range(3)], "tr long, voxels array<double>")
    got = {(r["tr"], r["x"], r["y"], r["z"]): r["v"] for r in packed.long_form(batches.cut(volumes, shape, at), box).collect()}
    want = {(r["tr"], r["x"], r["y"], r["z"]): r["v"] for r in volume.cut_eyes(packed.long_form(volumes, shape), mask).collect()}
    assert got == pytest.approx(want)


def test_an_image_of_real_size(spark):
    """One image of 91 x 109 x 91 through registration, cutting and normalisation."""
    shape, half = (91, 109, 91), 2.2
    points = grid(shape)
    template = phantom(points, half)
    m = register.matrix(np.array([0.05, -0.04, 0.06, np.log(1.05), 2.0, -1.5, 1.0]), shape)
    image = moved(shape, m, half).astype(np.float32)
    eyes = np.zeros(shape, bool)
    eyes[22:41, 30:50, 24:42] = eyes[48:67, 30:50, 24:42] = True
    mask = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(eyes)], "x long, y long, z long")
    scanned = spark.createDataFrame([("a", t, (image * (5 + t)).ravel().tolist()) for t in range(2)], "path string, tr long, voxels array<float>")
    goal = spark.createDataFrame([(template.ravel().tolist(),)], "voxels array<double>")
    t = time.time()
    out, box = preprocess.eyes(scanned, goal, mask, shape, masks=[None, eyes.ravel()])
    rows = out.collect()
    assert time.time() - t < 200 and box == (44, 19, 17) and len(rows) == 2 and all(len(r["voxels"]) == 44 * 19 * 17 for r in rows)
    found = np.array(register.similarity(scanned, template.ravel(), shape, ("path",)).first()["matrix"]).reshape(3, 4)
    assert np.abs(found - m).max() < 0.2
