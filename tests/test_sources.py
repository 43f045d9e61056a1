"""Round trips of the file formats, and the cases that must fail or come out null."""

import gzip

import numpy as np
import pytest

from volumetra.sources import archives, nifti


def test_nifti_round_trip(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=(3, 4, 5, 6)).astype(np.float32)
    v[0, 0, 0, 0] = np.nan
    (tmp_path / "a.nii").write_bytes(nifti.encode(v))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(nifti.encode(v + 1)))
    (tmp_path / "c.txt").write_text("not an image")
    scanned = nifti.scan(spark, str(tmp_path))
    rows = {(r["path"].rsplit("/", 1)[1], r["tr"]): r for r in scanned.collect()}
    assert len(rows) == 12
    for (name, t), r in rows.items():
        got = np.array([np.nan if x is None else x for x in r["voxels"]], dtype=np.float32).reshape(r["nx"], r["ny"], r["nz"])
        assert np.array_equal(got, v[..., t] + (name == "b.nii.gz"), equal_nan=True)
    assert rows["a.nii", 0]["voxels"][0] is None
    one = nifti.long_form(scanned).where("path like '%b.nii.gz' and tr = 2 and x = 1 and y = 2 and z = 3").first()
    assert one["v"] == pytest.approx(float(v[1, 2, 3, 2]) + 1, abs=1e-6)
    again = {r["path"].rsplit("/", 1)[1]: nifti.Image(bytes(r["content"])) for r in nifti.encode_series(scanned).collect()}
    assert again["a.nii"].shape == (3, 4, 5, 6)
    assert np.array_equal(again["a.nii"].volume(3), v[..., 3].ravel())


def test_nifti_scaling_types_and_byte_order():
    import struct

    data = bytearray(nifti.encode(np.zeros((2, 1, 1, 2))))
    struct.pack_into("<2h", data, 70, 4, 16)
    struct.pack_into("<2f", data, 112, 0.5, 10.0)
    image = nifti.Image(bytes(data[: nifti.OFFSET]) + np.array([2, 4, 6, 8], "<i2").tobytes())
    assert image.volume(1).tolist() == [13.0, 14.0]
    big = bytearray(nifti.OFFSET)
    struct.pack_into(">i", big, 0, 348)
    struct.pack_into(">8h", big, 40, 3, 2, 1, 1, 1, 1, 1, 1)
    struct.pack_into(">2h", big, 70, 16, 32)
    struct.pack_into(">f", big, 108, 352.0)
    big[344:348] = b"n+1\0"
    assert nifti.Image(bytes(big) + np.array([1, 2], ">f4").tobytes()).volume(0).tolist() == [1.0, 2.0]


@pytest.mark.parametrize("data", [b"", b"x" * 400, nifti.encode(np.zeros((2, 2, 2, 2)))[:-1]])
def test_nifti_refuses_what_is_no_image(data):
    with pytest.raises(ValueError):
        nifti.Image(data)


def test_npz_archives(spark, tmp_path):
    label = np.arange(20, dtype=np.float32).reshape(10, 2)
    label[3, 1] = np.nan
    with_ids = {f"{k}_{t}": x for t in range(4) for k, x in (("data", np.full((2, 2), t)), ("label", label + t), ("identifier", np.array(["run", str(t)])))}
    np.savez(tmp_path / "p1.npz", **with_ids)
    np.savez(tmp_path / "p2.npz", data_0=np.ones(3), label_0=label, data_1=np.ones(3))
    rows = {(r["path"].rsplit("/", 1)[1], r["tr"]): r for r in archives.scan_npz(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [("p1.npz", t) for t in range(4)] + [("p2.npz", 0)]
    assert rows["p1.npz", 2]["identifier"] == "run_2" and rows["p2.npz", 0]["identifier"] is None
    assert rows["p1.npz", 2]["voxels"] == [2.0] * 4 and rows["p1.npz", 0]["labels"][3] == [6.0, None]
    part = archives.scan_npz(spark, str(tmp_path), 1, 2)
    assert sorted(r["tr"] for r in part.collect()) == [1, 2]
    samples = archives.label_samples(part).where("tr = 1 and sub = 4").first()
    assert (samples["x"], samples["y"]) == (9.0, 10.0)


def test_label_csv_keeps_the_order_of_lines(spark, tmp_path):
    (tmp_path / "stim.csv").write_text("x,y\n0.1,0.2\n-0.5,nothing\n\n0.3, 0.4\n")
    rows = archives.scan_labels_csv(spark, str(tmp_path)).orderBy("i").collect()
    assert [(r["px"], r["py"]) for r in rows] == [(0.1, 0.2), (-0.5, None), (0.3, 0.4)]


def test_participants_written_and_read(spark, tmp_path):
    v = spark.createDataFrame([("d", "p", 0, t, [float(t)] * 3) for t in range(5)], "dataset string, participant string, run int, tr long, voxels array<float>")
    y = spark.createDataFrame([("d", "p", 0, t, s, float(s), 2.0 * s) for t in range(1, 7) for s in range(3)], "dataset string, participant string, run int, tr long, sub int, x double, y double")
    archives.write_participants(v, y, str(tmp_path / "out"), center=True)
    rows = archives.read_participants(spark, str(tmp_path / "out"), 2, 9).orderBy("tr").collect()
    assert [r["tr"] for r in rows] == [2, 3, 4]
    assert [(s["sub"], s["x"], s["y"]) for s in rows[0]["labels"]] == [(0, -1.0, -2.0), (1, 0.0, 0.0), (2, 1.0, 2.0)]


def test_masks_and_template(spark, tmp_path):
    from volumetra.sources import masks

    m = np.zeros((4, 3, 2, 1), dtype=np.float32)
    m[0, 0, 0] = m[3, 2, 1] = 1
    (tmp_path / "small.mask.nii.gz").write_bytes(gzip.compress(nifti.encode(m)))
    (tmp_path / "big.nii").write_bytes(nifti.encode(np.ones((4, 3, 2, 1), dtype=np.float32)))
    found = masks.scan_masks(spark, str(tmp_path))
    voxels, edges = masks.mask(found, "small")
    assert sorted(map(tuple, voxels.collect())) == [(0, 0, 0), (3, 2, 1)] and edges.first()["gap_mid"] == 1
    assert masks.mask(found, "big")[0].count() == 24
    assert masks.template(spark, str(tmp_path / "big.nii")).where("v = 1").count() == 24
    listed = {r["path"].rsplit("/", 1)[1]: r["length"] for r in masks.list_files(spark, str(tmp_path), "*.nii").collect()}
    assert listed == {"big.nii": (tmp_path / "big.nii").stat().st_size}


def test_event_logs(spark, tmp_path):
    from volumetra.sources import masks

    lines = ["0 0 9 9"] + [f"{int(i % 6 == 0)} {i + 1} {i} {-i}" for i in range(12)] + ["0 0 9 9", "1 1 50 60"]
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    rows = sorted(tuple(r)[1:] for r in masks.scan_log(spark, str(tmp_path / "log.txt"), span=6, k=4).collect())
    first, second = [0, 2, 4, 6], [6, 7, 9, 11]
    want = [(1, 0, j, float(v), float(-v)) for j, v in enumerate(first)] + [(1, 1, j, float(v), float(-v)) for j, v in enumerate(second)] + [(2, 0, j, 50.0, 60.0) for j in range(4)]
    assert rows == want


def test_csv_output(spark, tmp_path):
    from volumetra.sources import masks

    masks.write_csv(spark.createDataFrame([(1, 0.5), (2, None)], "tr long, x double"), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [("1", "0.5"), ("2", None)]


def test_streamed_summaries_equal_those_of_the_table(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from volumetra import streaming

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the test tables")
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.summaries(streaming.read_samples(spark, str(tmp_path / "in")))
    query = streaming.write(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120)
    x = F.when(F.col("event_type") != "error", F.col("value"))
    want = table.groupBy(F.col("user_id").alias("participant"), F.window(F.col("ts").cast("timestamp"), "1 day")["start"].alias("start")).agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"))
    got = spark.read.parquet(str(tmp_path / "out"))
    last = got.agg(F.max("start")).first()[0]
    rows = lambda df: sorted((r["participant"], r["start"], r["n"], r["missing"], None if r["mean"] is None else round(r["mean"], 6)) for r in df.where(F.col("start") <= F.lit(last)).collect())
    assert rows(got) == rows(want) and len(rows(got)) > 100


def test_images_to_participants(spark, tmp_path):
    from volumetra.operators import preprocess
    from volumetra.sources import masks

    rng = np.random.default_rng(3)
    shape = (10, 4, 4)
    eye = np.zeros(shape, dtype=np.float32)
    eye[0:3, :3, :3] = eye[6:10, :3, :3] = 1
    (tmp_path / "template.nii").write_bytes(nifti.encode(eye[..., None]))
    (tmp_path / "mask.nii").write_bytes(nifti.encode(eye[..., None]))
    for p in ("p01", "p02"):
        (tmp_path / "images" / p).mkdir(parents=True)
        for run in ("a", "b"):
            v = eye[..., None] * (5 + rng.random((*shape, 6)))
            (tmp_path / "images" / p / f"{run}.nii").write_bytes(nifti.encode(v.astype(np.float32)))
    mask, _ = masks.mask(masks.scan_masks(spark, str(tmp_path / "mask.nii")), "mask")
    template = nifti.scan(spark, str(tmp_path / "template.nii"))
    eyes, box = preprocess.eyes(nifti.scan(spark, str(tmp_path / "images")), template, mask, shape)
    assert box == (9, 2, 2)
    volumes = preprocess.participants(eyes, "d")
    rows = volumes.collect()
    assert {(r["participant"], r["run"], r["tr"]) for r in rows} == {(p, k, t) for p in ("p01", "p02") for k in (0, 1) for t in range(6)}
    assert all(len(r["voxels"]) == 36 and max(map(abs, r["voxels"])) < 10 for r in rows) and any(any(r["voxels"]) for r in rows)
    labels = spark.createDataFrame([("d", "p01", 0, t, s, 1.0, 2.0) for t in range(6) for s in range(2)], "dataset string, participant string, run int, tr long, sub int, x double, y double")
    archives.write_participants(volumes, labels, str(tmp_path / "out"))
    assert archives.read_participants(spark, str(tmp_path / "out")).count() == 6
