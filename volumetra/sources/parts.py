"""Data sources that read only the parts of a file that are asked for, sinks that commit, and a stream of batches that resumes.

``register(spark)`` makes these formats known:

* ``volumetra_npz``, ``volumetra_nifti`` (read): a file is read in parts of ``PART_BYTES``, and bounds on ``tr`` reach the reader, so of an archive only its directory and the members of the
  wanted TRs are fetched, and of an image its header and the wanted volumes. A gzipped image is one part, read up to its last wanted volume.
* ``volumetra_npz``, ``volumetra_nifti`` (write, see ``write_series``): one file a participant, TR after TR; files appear when the whole job has succeeded, and none if it fails.
* ``volumetra_draws`` (stream): the slots of numbered batches; the offset is the batch number, so any batch can be made again.

Files are opened through ``pyarrow.fs``: paths are local or of a store that pyarrow knows.
"""

from __future__ import annotations

import gzip
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    SimpleDataSourceStreamReader, WriterCommitMessage,
)

from volumetra.sources import nifti
from volumetra.sources.archives import _MEMBER, SCHEMA, _text

#: Bytes of a file that one task reads.
PART_BYTES = 64 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def opened(path: str):
    """A file for reads at any place."""
    files, place = located(path)
    return files.open_input_file(place)


def listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files with one of the suffixes below a folder."""
    files, place = located(path)
    info = files.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else [f for f in files.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File]
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.path.endswith(suffixes))


@dataclass
class Part(InputPartition):
    """Part ``k`` of ``n`` of a file."""

    path: str
    k: int
    n: int


class _Reader(DataSourceReader):
    """Files in parts, for TRs from ``low`` to ``high``, both included."""

    def __init__(self, options: dict, suffixes: tuple[str, ...]):
        self.path, self.suffixes, self.part_bytes = options["path"], suffixes, int(options.get("partBytes", PART_BYTES))
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("tr",) or not isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)):
                yield f
                continue
            values = list(f.value) if isinstance(f, In) else [f.value]
            if isinstance(f, In):
                yield f  # its bounds alone are used here
            if not values or None in values:
                continue
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.low = max(self.low, min(values) + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.high = min(self.high, max(values) - isinstance(f, LessThan))

    def partitions(self) -> list[Part]:
        out = []
        for path, size in listed(self.path, self.suffixes):
            n = 1 if path.endswith(".gz") else max(1, -(-size // self.part_bytes))
            out += [Part(path, k, n) for k in range(n)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            yield from self.decoded(f, partition)


class ArchiveReader(_Reader):
    KINDS = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.float32()), pa.list_(pa.list_(pa.float32()))]

    def decoded(self, f, part: Part) -> Iterator[pa.RecordBatch]:
        size = f.size()
        with zipfile.ZipFile(f) as archive:
            members: dict[int, dict[str, zipfile.ZipInfo]] = {}
            for info in archive.infolist():
                m = _MEMBER.fullmatch(info.filename.removesuffix(".npy"))
                if m and self.low <= int(m[2]) <= self.high:
                    members.setdefault(int(m[2]), {})[m[1]] = info
            load = lambda info: np.lib.format.read_array(archive.open(info), allow_pickle=False)
            for tr, own in sorted(members.items()):
                if not {"data", "label"} <= set(own) or own["data"].header_offset * part.n // max(size, 1) != part.k:
                    continue
                labels = np.atleast_2d(load(own["label"])).astype(np.float32)
                identifier = _text(load(own["identifier"])) if "identifier" in own else None
                values = [part.path], [tr], [identifier], [load(own["data"]).astype(np.float32).ravel()], [list(labels)]
                yield pa.RecordBatch.from_arrays([pa.array(v, k, from_pandas=True) for v, k in zip(values, self.KINDS)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class ImageReader(_Reader):
    KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32())]

    def decoded(self, f, part: Part) -> Iterator[pa.RecordBatch]:
        f = gzip.GzipFile(fileobj=f) if part.path.endswith(".gz") else f
        try:
            head = nifti.Header(f.read(nifti.HEADER))
            nt = head.shape[3]
            for t in range(max(self.low, nt * part.k // part.n), min(self.high + 1, nt * (part.k + 1) // part.n)):
                f.seek(head.offset + t * head.bytes)
                raw = f.read(head.bytes)
                if len(raw) < head.bytes:
                    raise ValueError("the file ends before its last volume")
                v = head.decode(raw)
                values = [part.path], [t], *[[n] for n in head.shape[:3]], [np.where(np.isfinite(v), v, np.nan)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k, from_pandas=True) for x, k in zip(values, self.KINDS)], names=[c.split()[0] for c in nifti.SCHEMA.split(", ")])
        except (ValueError, OSError, EOFError) as e:
            raise ValueError(f"{part.path}: {e}") from e


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (where it lies, where it belongs)."""

    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Rows of a participant come one after the other, by TR. Each task writes under a temporary name; the commit moves what belongs to the job and deletes the rest."""

    suffix = ""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = located(self.temporary)
        files.create_dir(folder, recursive=True)
        done, name, out = [], None, None
        try:
            for batch in iterator:
                for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                    who = str(row.column("participant")[0].as_py())
                    if who != name:
                        if out is not None:
                            self.end(out)
                        name, place = who, f"{folder}/{uuid.uuid4().hex}"
                        done.append((place, f"{located(self.path)[1]}/{who}{self.suffix}"))
                        out = self.begin(files.open_output_stream(place), row)
                    self.add(out, row)
            if out is not None:
                self.end(out)
        except BaseException:
            for place, _ in done:
                if files.get_file_info(place).type == fs.FileType.File:
                    files.delete_file(place)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = located(self.path)
        kept = [f for m in messages if m is not None for f in m.files]
        if len({end for _, end in kept}) < len(kept):
            self.abort(messages)
            raise ValueError("a participant was written by two tasks: deal the rows by participant and sort them")
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.path.endswith(self.suffix):
                    files.delete_file(f.path)
        for place, end in kept:  # one file a participant
            files.move(place, end)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = located(self.temporary)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


def _value(row: pa.RecordBatch, column: str):
    return row.column(column)[0].as_py() if column in row.schema.names else None


def _floats(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], np.float32)


class ArchiveWriter(_Writer):
    """participant, tr, voxels, labels; identifier and dims if there are any."""

    suffix = ".npz"

    def begin(self, stream, row):
        return stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)

    def add(self, out, row) -> None:
        tr, dims, names = _value(row, "tr"), _value(row, "dims"), _value(row, "identifier")
        voxels = np.asarray(row.column("voxels")[0].values.to_numpy(zero_copy_only=False), np.float32)
        parts = {"data": voxels if dims is None else voxels.reshape(dims), "label": np.stack([_floats(r) for r in _value(row, "labels")])}
        if names is not None:
            parts["identifier"] = np.array(names)
        for kind, value in parts.items():
            with out[1].open(f"{kind}_{tr}.npy", "w", force_zip64=True) as f:
                np.lib.format.write_array(f, value, allow_pickle=False)

    def end(self, out) -> None:
        out[1].close()
        out[0].close()


class ImageWriter(_Writer):
    """participant, tr, nx, ny, nz, n_tr (volumes of the series), voxels; missing voxels become 0."""

    suffix = ".nii"

    def begin(self, stream, row):
        shape = tuple(_value(row, c) for c in ("nx", "ny", "nz", "n_tr"))
        stream.write(nifti.encode_header(shape))
        return [stream, shape, 0]

    def add(self, out, row) -> None:
        stream, shape, _ = out
        cube = np.nan_to_num(row.column("voxels")[0].values.to_numpy(zero_copy_only=False)).astype("<f4").reshape(shape[:3])
        stream.write(cube.tobytes(order="F"))
        out[2] += 1

    def end(self, out) -> None:
        out[0].close()
        if out[2] != out[1][3]:
            raise ValueError(f"a series of {out[1][3]} volumes has {out[2]} rows together: deal the rows by participant and sort them")


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volumetra_npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options, (".npz",))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return ArchiveWriter(self.options, overwrite)


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volumetra_nifti"

    def schema(self) -> str:
        return nifti.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ImageReader(self.options, (".nii", ".nii.gz"))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return ImageWriter(self.options, overwrite)


class DrawReader(SimpleDataSourceStreamReader):
    """Slots of batches; only their numbers pass here, the samples are joined to them."""

    def __init__(self, options: dict):
        self.steps, self.batch, self.until, self.a_time = (int(options.get(k, d)) for k, d in (("steps", 1500), ("batch", 8), ("until", 1 << 62), ("batchesPerTrigger", 100)))

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def read(self, start: dict):
        end = {"batch": max(start["batch"], min(self.until, start["batch"] + self.a_time))}
        return iter(list(self.readBetweenOffsets(start, end))), end  # a_time batches of numbers; Spark copies the iterator

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for b in range(start["batch"], end["batch"]):
            for slot in range(self.batch):
                yield b * self.batch + slot, b // self.steps, b % self.steps, slot


class DrawSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volumetra_draws"

    def schema(self) -> str:
        return "id long, epoch long, step long, slot long"

    def simpleStreamReader(self, schema) -> DrawReader:
        return DrawReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ArchiveSource, ImageSource, DrawSource):
        spark.dataSource.register(source)


def read_npz(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of ``archives.scan_npz``; bounds on ``tr`` reach the files."""
    register(spark)
    return spark.read.format("volumetra_npz").options(**options).load(path)


def read_nifti(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of ``nifti.scan``; bounds on ``tr`` reach the files."""
    register(spark)
    return spark.read.format("volumetra_nifti").options(**options).load(path)


def write_series(rows: DataFrame, path: str, kind: str, mode: str = "append") -> None:
    """One file a participant: ``npz`` from participant, tr, voxels, labels (identifier, dims), ``nifti`` from participant, tr, nx, ny, nz, voxels.

    A series is one file, so one task writes it, volume after volume; ``overwrite`` deletes the files of that kind which are there.
    """
    register(rows.sparkSession)
    if kind == "nifti":
        rows = rows.join(rows.groupBy("participant").agg(F.count(F.lit(1)).cast("int").alias("n_tr")), "participant")
    rows.repartition("participant").sortWithinPartitions("participant", "tr").write.format(f"volumetra_{kind}").mode(mode).save(path)
