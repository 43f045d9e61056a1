"""Volumes in NIfTI-1 files (single file, plain or gzipped): a scan with one row per file and time point, and a writer.

The header is read by the public format: 348 bytes, dimensions at 40, data type at 70, voxel sizes at 76, data offset at 108,
slope and intercept at 112 and 116, affine rows at 280. Data lie with x fastest. A slope of 0 means unscaled.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER, OFFSET = 348, 352
SCHEMA = "path string, tr long, nx int, ny int, nz int, voxels array<float>"


class Header:
    """Shape (x, y, z, t), voxel sizes, affine and where the volumes lie, from the first ``HEADER`` bytes of a file."""

    def __init__(self, data: bytes):
        if len(data) < HEADER:
            raise ValueError(f"{len(data)} bytes are no NIfTI-1 header")
        order = next((o for o in "<>" if struct.unpack_from(f"{o}i", data)[0] == HEADER), None)
        if order is None or data[344:347] not in (b"n+1", b"ni1"):
            raise ValueError("not a NIfTI-1 file")
        dims = struct.unpack_from(f"{order}8h", data, 40)
        sizes = [max(1, d) for d in dims[1 : dims[0] + 1]] + [1] * 4
        self.shape, (code,) = tuple(sizes[:4]), struct.unpack_from(f"{order}h", data, 70)
        if code not in TYPES:
            raise ValueError(f"data type {code} is not supported")
        self.zooms = struct.unpack_from(f"{order}8f", data, 76)[1:5]
        offset, slope, intercept = struct.unpack_from(f"{order}3f", data, 108)
        self.slope, self.intercept = (slope, intercept) if slope else (1.0, 0.0)
        self.affine = np.array(struct.unpack_from(f"{order}12f", data, 280)).reshape(3, 4)
        self._type = np.dtype(TYPES[code]).newbyteorder(order)
        self.offset, self.bytes = int(offset) or OFFSET, int(np.prod(self.shape[:3])) * self._type.itemsize

    def decode(self, raw: bytes) -> np.ndarray:
        """A volume's bytes as float32, flattened with z fastest, as the grids of this package number their voxels."""
        cube = np.frombuffer(raw, self._type).astype(np.float64).reshape(self.shape[:3], order="F") * self.slope + self.intercept
        return cube.astype(np.float32).ravel()


class Image(Header):
    """A whole file's bytes, whose volumes are decoded when asked for."""

    def __init__(self, data: bytes):
        self._data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        super().__init__(self._data)
        if len(self._data) < self.offset + self.bytes * self.shape[3]:
            raise ValueError("the file ends before its last volume")

    def volume(self, t: int) -> np.ndarray:
        at = self.offset + t * self.bytes
        return self.decode(self._data[at : at + self.bytes])


def encode_header(shape: tuple[int, int, int, int], zooms=(1.0, 1.0, 1.0, 1.0), affine: np.ndarray | None = None) -> bytes:
    """What a float32 NIfTI-1 file starts with."""
    affine = np.eye(4)[:3] if affine is None else affine
    header = bytearray(OFFSET)
    struct.pack_into("<i", header, 0, HEADER)
    struct.pack_into("<8h", header, 40, 4, *shape, 1, 1, 1)
    struct.pack_into("<2h", header, 70, 16, 32)
    struct.pack_into("<8f", header, 76, 1.0, *zooms, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", header, 108, OFFSET, 1.0, 0.0)
    struct.pack_into("<2h", header, 252, 0, 1)
    struct.pack_into("<12f", header, 280, *np.asarray(affine, dtype=float).ravel())
    header[344:348] = b"n+1\0"
    return bytes(header)


def encode(volumes: np.ndarray, zooms=(1.0, 1.0, 1.0, 1.0), affine: np.ndarray | None = None) -> bytes:
    """The bytes of a float32 NIfTI-1 file from an array (x, y, z, t)."""
    return encode_header(volumes.shape, zooms, affine) + volumes.astype("<f4").tobytes(order="F")


def scan(spark: SparkSession, path: str, pattern: str = "*.nii*") -> DataFrame:
    """One row per file and time point. Spark's own reader lists and fetches the files, so any store it knows will do.

    Values that are not finite become null. A file that is no NIfTI-1 image raises an error that names it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    image = Image(content)
                except (ValueError, OSError, EOFError) as e:
                    raise ValueError(f"{name}: {e}") from e
                nx, ny, nz, nt = image.shape
                for t in range(nt):
                    yield pd.DataFrame({"path": [name], "tr": [t], "nx": [nx], "ny": [ny], "nz": [nz], "voxels": [image.volume(t)]})

    out = files.mapInPandas(decode, SCHEMA)
    return out.withColumn("voxels", F.transform("voxels", lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)))


def long_form(volumes: DataFrame) -> DataFrame:
    """path, tr, x, y, z, v of scanned volumes."""
    v = volumes.select("path", "tr", "ny", "nz", F.posexplode("voxels").alias("i", "v"))
    return v.select("path", "tr", *[F.expr(e).cast("long").alias(c) for c, e in zip("xyz", ("i div (ny * nz)", "(i div nz) % ny", "i % nz"))],
        F.col("v").cast("double").alias("v"))


def encode_series(volumes: DataFrame, key: str = "path") -> DataFrame:
    """(key, content): the rows (key, tr, nx, ny, nz, voxels) of each series as the bytes of one file, in the order of tr; null voxels become 0.

    A series is one file, so it must fit into a task, as the format asks for.
    """

    def pack(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("tr")
        shape = tuple(int(series[c].iloc[0]) for c in ("nx", "ny", "nz"))
        cubes = [np.nan_to_num(np.array(v, dtype=np.float32)).reshape(shape) for v in series["voxels"]]
        return pd.DataFrame({key: [series[key].iloc[0]], "content": [encode(np.stack(cubes, axis=3))]})

    return volumes.groupBy(key).applyInPandas(pack, f"{key} string, content binary")
