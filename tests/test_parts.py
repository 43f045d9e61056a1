"""Sources that read parts, sinks that commit, the stream of batches, MAT files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

from volumetra.operators import labels
from volumetra.sources import archives, mat, nifti, parts


class Counting:
    """A file that counts the bytes that are read."""

    total = 0

    def __init__(self, file):
        self.file = file

    def read(self, *n):
        data = self.file.read(*n)
        Counting.total += len(data)
        return data

    def __getattr__(self, name):
        return getattr(self.file, name)

    def __enter__(self):
        return self

    def __exit__(self, *x):
        self.file.close()


@pytest.fixture
def counted(monkeypatch):
    real = parts.opened
    monkeypatch.setattr(parts, "opened", lambda path: Counting(real(path)))
    Counting.total = 0
    return Counting


def archive(path, trs, voxels=2000):
    rng = np.random.default_rng(0)
    np.savez(path, **{k: v for t in trs for k, v in ((f"data_{t}", rng.random((voxels // 10, 10, 1)).astype(np.float32)), (f"label_{t}", np.array([[t, np.nan], [t + 0.5, 1]])), (f"identifier_{t}", np.array(["p", str(t)])))}, junk=np.zeros(3))


def series(path, nt=30, shape=(6, 5, 4)):
    v = np.random.default_rng(1).random((*shape, nt)).astype(np.float32)
    v[0, 0, 0, 2] = np.nan
    path.write_bytes(nifti.encode(v))
    return v


def read_in_process(reader, filters=()):
    rest = list(reader.pushFilters(list(filters)))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return rows, rest


def test_one_tr_of_an_archive_reads_its_members_alone(tmp_path, counted):
    archive(tmp_path / "a.npz", range(40))
    size = (tmp_path / "a.npz").stat().st_size
    every, _ = read_in_process(parts.ArchiveReader({"path": str(tmp_path)}, (".npz",)))
    assert [r["tr"] for r in every] == list(range(40)) and counted.total > 0.8 * size
    counted.total = 0
    one, rest = read_in_process(parts.ArchiveReader({"path": str(tmp_path)}, (".npz",)), [EqualTo(("tr",), 17)])
    assert one == [every[17]] and rest == [] and counted.total < 0.1 * size
    split = parts.ArchiveReader({"path": str(tmp_path), "partBytes": str(size // 7)}, (".npz",))
    assert len(split.partitions()) == 8 and read_in_process(split)[0] == every


def test_one_volume_of_an_image_reads_header_and_volume(tmp_path, counted):
    v = series(tmp_path / "a.nii")
    per = 6 * 5 * 4 * 4
    reader = lambda **o: parts.ImageReader({"path": str(tmp_path), **o}, (".nii", ".nii.gz"))
    rows, rest = read_in_process(reader(), [EqualTo(("tr",), 7), StringContains(("path",), "a")])
    assert len(rows) == 1 and np.allclose(rows[0]["voxels"], v[..., 7].ravel()) and len(rest) == 1
    assert counted.total == nifti.HEADER + per
    assert [r["tr"] for r in read_in_process(reader(partBytes=str(3 * per)))[0]] == list(range(30))
    rows, rest = read_in_process(reader(), [GreaterThan(("tr",), 3), LessThanOrEqual(("tr",), 6)])
    assert [r["tr"] for r in rows] == [4, 5, 6] and not rest
    rows, rest = read_in_process(reader(), [In(("tr",), (2, 4))])
    assert [r["tr"] for r in rows] == [2, 3, 4] and len(rest) == 1
    assert rows[0]["voxels"][0] is None


def test_sources_equal_the_whole_file_scans(spark, tmp_path):
    import gzip

    archive(tmp_path / "a.npz", [0, 3, 5])
    (tmp_path / "sub").mkdir()
    archive(tmp_path / "sub" / "b.npz", [1])
    series(tmp_path / "c.nii", 5)
    (tmp_path / "d.nii.gz").write_bytes(gzip.compress((tmp_path / "c.nii").read_bytes()))
    name = F.substring_index("path", "/", -1)
    rows = lambda df: sorted(map(tuple, df.withColumn("path", name).collect()), key=str)
    assert rows(parts.read_npz(spark, str(tmp_path))) == rows(archives.scan_npz(spark, str(tmp_path)))
    assert rows(parts.read_npz(spark, str(tmp_path)).where("tr >= 3")) == rows(archives.scan_npz(spark, str(tmp_path), 3))
    both, whole = parts.read_nifti(spark, str(tmp_path)), nifti.scan(spark, str(tmp_path))
    assert rows(both) == rows(whole) and len(rows(both)) == 10
    assert rows(both.where("tr = 2 or tr = 4")) == rows(whole.where("tr in (2, 4)")) and rows(both.where("tr < 0")) == []
    (tmp_path / "e.nii").write_bytes((tmp_path / "c.nii").read_bytes()[:-10])
    with pytest.raises(PySparkException, match="e.nii"):
        parts.read_nifti(spark, str(tmp_path)).collect()


def participants(spark, bad=False):
    rng = np.random.default_rng(2)
    rows = [(p, t, [float(x) for x in rng.random(7 if bad and (p, t) == ("p2", 3) else 8).astype(np.float32)], [2, 2, 2], [[1.0, None], [float(t), 2.0]], p) for p in ("p1", "p2", "p3") for t in (2, 0, 1, 3)]
    return spark.createDataFrame(rows, "participant string, tr long, voxels array<float>, dims array<int>, labels array<array<float>>, identifier string").repartition(5)


def test_archives_written_scan_back(spark, tmp_path):
    df, out = participants(spark), tmp_path / "out"
    parts.write_series(df, str(out), "npz")
    assert sorted(f.name for f in out.iterdir()) == ["p1.npz", "p2.npz", "p3.npz"]
    back = archives.scan_npz(spark, str(out)).select("identifier", "tr", "voxels", "labels")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select("identifier", "tr", "voxels", "labels").collect()))
    assert np.load(out / "p1.npz")["data_2"].shape == (2, 2, 2)
    parts.write_series(df.where("participant = 'p1'"), str(out), "npz", "overwrite")
    assert [f.name for f in out.iterdir()] == ["p1.npz"]


def test_images_written_scan_back(spark, tmp_path):
    df = participants(spark).select("participant", "tr", "voxels", *[F.lit(2).alias(c) for c in ("nx", "ny", "nz")])
    parts.write_series(df, str(tmp_path / "out"), "nifti")
    back = nifti.scan(spark, str(tmp_path / "out")).select(F.regexp_extract("path", r"([^/]*)\.nii", 1), "tr", "voxels")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select("participant", "tr", "voxels").collect()))


@pytest.mark.parametrize("kind", ["npz", "nifti"])
def test_a_failed_task_leaves_no_file(spark, tmp_path, kind):
    df = participants(spark, bad=True).select("*", *[F.lit(2).alias(c) for c in ("nx", "ny", "nz")])
    with pytest.raises(PySparkException):
        parts.write_series(df, str(tmp_path / "out"), kind)
    assert not [f for f in (tmp_path / "out").rglob("*")]


def test_rows_of_a_participant_in_two_tasks_are_refused(spark, tmp_path):
    parts.register(spark)
    with pytest.raises(PySparkException, match="two tasks"):
        participants(spark).repartition(4, "tr").sortWithinPartitions("participant").write.format("volumetra_npz").mode("append").save(str(tmp_path / "out"))
    assert not [f for f in (tmp_path / "out").rglob("*")]


def test_batches_go_on_from_where_they_stopped(spark, tmp_path):
    from volumetra import streaming
    from volumetra.operators import splits

    rows = [(p, i, float(p * 100 + i), 0.5) for p in range(7) for i in range(10 + p)]
    spark.createDataFrame(rows, "participant long, rn long, x double, y double").write.parquet(str(tmp_path / "g"))
    g = spark.read.parquet(str(tmp_path / "g"))

    def run(until):
        stream = streaming.batches(g, 5, 4, until, a_time=5)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return listed(spark.read.parquet(str(tmp_path / "out")))

    listed = lambda df: sorted(map(tuple, df.select("epoch", "step", "slot", "participant", "rn", "x", "y").collect()))
    want = listed(splits.batches(g, 2, 5, 4))
    first = run(4)
    assert first == [r for r in want if r[0] * 5 + r[1] < 4]
    assert run(10) == want and len(want) == 40
    reader = parts.DrawReader({"steps": "5", "batch": "4"})
    assert list(reader.readBetweenOffsets({"batch": 7}, {"batch": 8})) == [(28 + s, 1, 2, s) for s in range(4)]


def element(kind, data, small=True):
    if small and len(data) <= 4 and kind != 14:
        return struct.pack("<2H", kind, len(data)) + data.ljust(4, b"\0")
    return struct.pack("<2I", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(value, name=b""):
    """A value as a MAT matrix: arrays, texts, lists (cells) and lists of dicts (structs)."""
    head = lambda class_, dims: element(6, struct.pack("<2I", class_, 0)) + element(5, np.array(dims, "<i4").tobytes()) + element(1, name)
    if isinstance(value, str):
        body = head(4, (1, len(value))) + element(4, value.encode("utf-16-le"))
    elif isinstance(value, list) and value and isinstance(value[0], dict):
        fields = list(value[0])
        body = head(2, (1, len(value))) + element(5, struct.pack("<i", 32)) + element(1, b"".join(f.encode().ljust(32, b"\0") for f in fields)) + b"".join(matrix(v[f]) for v in value for f in fields)
    elif isinstance(value, list):
        body = head(1, (1, len(value))) + b"".join(matrix(v) for v in value)
    else:
        value = np.atleast_2d(value)
        kind, class_ = {"f8": (9, 6), "f4": (7, 7), "i4": (5, 12), "u1": (2, 9)}[value.dtype.str[1:]]
        body = head(class_, value.shape) + element(kind, value.tobytes(order="F"))
    return element(14, body)


def mat_file(variables, deflate=True):
    out = b"a test file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, value in variables.items():
        one = matrix(value, name.encode())
        if deflate:
            data = zlib.compress(one)
            one = struct.pack("<2I", 15, len(data)) + data
        out += one
    return out


@pytest.mark.parametrize("deflate", [True, False])
def test_mat_leaves(deflate):
    value = {"a": np.array([[1.5, 2, 3], [4, 5, np.nan]]), "long_name": "häl", "c": [np.zeros((0, 2)), [np.arange(3, dtype="<i4")], "x"], "s": [{"f": np.array([[7]], "u1"), "g": "q"}, {"f": np.array([[1.25]], "<f4"), "g": ""}], "e": []}
    got = {tuple(w): (k, d, None if n is None else n.tolist(), t) for w, k, d, n, t in mat.leaves(mat_file(value, deflate))}
    assert got["a",][:2] == ("matrix", [2, 3]) and got["a",][2][:5] == [1.5, 4, 2, 5, 3]
    assert got["long_name",] == ("text", [1, 3], None, "häl")
    assert got["c", "0"] == ("matrix", [0, 2], [], None) and got["c", "1", "0"] == ("matrix", [1, 3], [0, 1, 2], None) and got["c", "2"][3] == "x"
    assert got["s", "0", "f"][2] == [7] and got["s", "1", "f"][2] == [1.25] and got["s", "1", "g"][3] == ""
    assert got["e",] == ("cell", [1, 0], [], None) and len(got) == 10


def test_mat_awkward_files(spark, tmp_path):
    whole = mat_file({"a": np.ones((3, 3))}, False)
    for data in (b"", whole[:100], whole[:126] + b"XX" + whole[128:], whole[:-8]):
        with pytest.raises(ValueError):
            list(mat.leaves(data))
    (tmp_path / "bad.mat").write_bytes(whole[:-8])
    with pytest.raises(PySparkException, match="bad.mat"):
        mat.scan(spark, str(tmp_path)).collect()
    assert list(mat.leaves(whole[:128])) == []


def test_mat_labels(spark, tmp_path):
    """Structs of subjects with cells of runs of cells of TRs: means, targets with measured positions where there are any, and measured ones alone."""
    rng = np.random.default_rng(0)
    two = lambda n: rng.random((2, n))
    target = [[two(5), two(4), np.zeros((0, 0))], [two(6)]]
    real = [[two(5), two(7), np.zeros((0, 0))], [np.zeros((0, 0))]]
    subject = lambda s, r: {"subID": s, "TR_xy": [rng.random((3, 2)), rng.random((1, 2))], "TR_xy_samples": target, "TR_xy_samples_ET": r}
    data = [subject("17", real), subject("18", [[np.zeros((0, 0))] * 3, [np.zeros((0, 0))]])]
    (tmp_path / "a.mat").write_bytes(mat_file({"subjects": data}))
    found = mat.scan(spark, str(tmp_path)).cache()
    means = {(r["participant"], r["run"], r["tr"]): (r["x"], r["y"]) for r in mat.means(found, "subjects").collect()}
    assert means["17", 0, 2] == pytest.approx(tuple(data[0]["TR_xy"][0][2])) and len(means) == 8
    samples = mat.samples(found, "subjects", "TR_xy_samples", "TR_xy_samples_ET")
    expected = mat.expected(found, "subjects", ("TR_xy_samples",))
    assert expected.count() == 8
    out = {(r["participant"], r["run"], r["tr"], r["sub"]): (r["x"], r["y"]) for r in labels.per_tr(labels.with_fallback(samples), expected, 10).collect()}
    assert len(out) == 80
    at = np.linspace(0, 6, 10, dtype=int)
    for j in range(10):
        assert out["17", 0, 1, j] == pytest.approx(tuple(real[0][1][:, at[j]]))
        assert out["17", 0, 2, j] == (None, None)
        assert out["18", 0, 0, j] == pytest.approx(tuple(target[0][0][:, np.linspace(0, 4, 10, dtype=int)[j]]))
        assert out["17", 1, 0, j] == pytest.approx(tuple(target[1][0][:, np.linspace(0, 5, 10, dtype=int)[j]]))
    alone = labels.measured_only(samples).where("x IS NOT NULL")
    assert alone.select("participant").distinct().collect()[0][0] == "17" and alone.count() == 12
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "p.mat").write_bytes(mat_file({"XY": [{"samples": [[rng.random((4, 2)), rng.random((3, 2))]], "samples_ET": [[rng.random((6, 2)), np.zeros((0, 0))]]}]}, False))
    one = mat.samples(mat.scan(spark, str(tmp_path / "b")), "XY", "samples", "samples_ET")
    assert one.select("participant").first()[0].endswith("p.mat") and one.where("rx IS NOT NULL").count() == 6 and one.where("tx IS NOT NULL").count() == 7
