"""Packed volumes in Arrow batches: a column of arrays becomes one NumPy block a batch, so kernels run over all volumes of a batch at once.

``packed`` writes the same steps as column expressions, voxel by voxel; these are for volumes of real size. No exchange. Volumes of a null become null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from volumetra.operators import packed

#: Bytes of a block of volumes that a kernel gets at a time.
BLOCK = 1 << 25
#: A kernel gets a block (volumes, voxels) and the other columns asked for, and returns an array (volumes, values).
Kernel = Callable[..., np.ndarray]


def block(column: pa.Array) -> np.ndarray:
    """(rows, voxels) as doubles; missing voxels are NaN. All arrays must be of one length."""
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values).reshape(len(column), -1)


def arrays(values: np.ndarray, missing: bool = False) -> pa.Array:
    """The rows of a block as a list column; NaN becomes null if ``missing``."""
    flat = np.ascontiguousarray(values, dtype=np.float64).ravel()
    at = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, from_pandas=missing))


def blocks(batches: Iterator[pa.RecordBatch], voxels: str, voxel_bytes: int = 8) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with a volume, of about ``BLOCK`` bytes each, and their voxels; ``voxel_bytes``: what a kernel needs for each."""
    for batch in batches:
        batch = batch.filter(batch.column(voxels).is_valid())
        if not batch.num_rows:
            continue
        each = max(1, len(batch.column(voxels)[0]) * voxel_bytes)
        step = max(1, BLOCK // each)
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part, block(part.column(voxels))


def _taken(column: pa.Array) -> np.ndarray:
    return block(column) if pa.types.is_list(column.type) else column.to_numpy(zero_copy_only=False)


def over(volumes: DataFrame, kernel: Kernel, keys: Sequence[str] = ("tr",), takes: Sequence[str] = (), voxels: str = "voxels", voxel_bytes: int = 8) -> DataFrame:
    """(keys, voxels) with ``kernel(block, *takes)`` in place of each block; what it returns as NaN becomes null."""
    chosen = list(dict.fromkeys([*keys, *takes, voxels]))
    kinds = {f.name: f.dataType.simpleString() for f in volumes.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, voxels, voxel_bytes):
            out = kernel(x, *[_taken(part.column(c)) for c in takes])
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], arrays(out, True)], names=[*keys, voxels])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{voxels} array<double>"])
    return volumes.select(*chosen).mapInArrow(run, schema)


def cells(shape: packed.Shape) -> np.ndarray:
    """(voxels, 3): x, y, z of each voxel in turn."""
    return np.indices(shape).reshape(3, -1).T


def gather(x: np.ndarray, shape: packed.Shape, at: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """The voxels of each row of ``x`` at whole coordinates ``at`` (voxels, 3) or (rows, voxels, 3); outside ``fill``."""
    inside = ((at >= 0) & (at < np.array(shape))).all(axis=-1)
    flat = np.where(inside, (at[..., 0] * shape[1] + at[..., 1]) * shape[2] + at[..., 2], 0)
    taken = np.take_along_axis(x, flat, axis=1) if flat.ndim == 2 else x[:, flat]
    return np.where(inside, taken, fill)


def nearest(v: np.ndarray) -> np.ndarray:
    """As ``packed`` rounds coordinates."""
    return np.floor(np.round(v, 9) + 0.5).astype(np.int64)


def shift(volumes: DataFrame, shape: packed.Shape, steps: Sequence[str] = ("dx", "dy", "dz"), keys: Sequence[str] = ("tr",)) -> DataFrame:
    """Each volume moved by the whole voxels in its columns ``steps``."""

    def kernel(x: np.ndarray, *by: np.ndarray) -> np.ndarray:
        return gather(x, shape, cells(shape)[None] - np.stack(by, axis=1)[:, None, :].astype(np.int64))

    return over(volumes, kernel, keys, steps, voxel_bytes=64)


def drawn(key: np.ndarray, salt: int, low: int, high: int) -> np.ndarray:
    """The numbers of ``packed.drawn``."""
    return ((key * 7919 + 104729 * salt + 13) % 100003) % (high - low + 1) + low


def turned(x: np.ndarray, shape: packed.Shape, key: np.ndarray, rotation: int, shifts: int, zooms: int) -> np.ndarray:
    """A block of volumes turned, moved and zoomed one after the other, each by what its key draws."""
    at, middle = cells(shape)[None].astype(float), (np.array(shape) - 1) / 2
    for axis in range(3) if rotation else ():
        a, b = [k for k in range(3) if k != axis]
        angle = np.radians(drawn(key, axis, -rotation, rotation).astype(float))[:, None]
        u, v, own = at[..., a] - middle[a], at[..., b] - middle[b], np.repeat(at, len(x), axis=0)
        own[..., a] = nearest(np.cos(angle) * u + np.sin(angle) * v + middle[a])
        own[..., b] = nearest(np.cos(angle) * v - np.sin(angle) * u + middle[b])
        x = gather(x, shape, own.astype(np.int64))
    if shifts:
        by = np.stack([drawn(key, 3 + k, -shifts, shifts) for k in range(3)], axis=1)
        x = gather(x, shape, cells(shape)[None] - by[:, None, :])
    if zooms:
        factor = (1 + drawn(key, 6, -zooms, zooms) / 100)[:, None, None]
        x = gather(x, shape, nearest((at - middle) / factor + middle))
    return x


def augment(volumes: DataFrame, shape: packed.Shape, rotation: int = 0, shifts: int = 0, zooms: int = 0, key: str = "tr", keys: Sequence[str] = ("tr",)) -> DataFrame:
    """``packed.augment`` over blocks."""
    return over(volumes, lambda x, k: turned(x, shape, k, rotation, shifts, zooms), keys, (key,), voxel_bytes=128)


def cut(volumes: DataFrame, shape: packed.Shape, places: np.ndarray, keys: Sequence[str] = ("tr",)) -> DataFrame:
    """The voxels with the numbers ``places``, in this order; 0 where the number is negative."""
    n = packed.size(shape)

    def kernel(x: np.ndarray) -> np.ndarray:
        if x.shape[1] != n:
            raise ValueError(f"volumes of {x.shape[1]} voxels where {n} were said")
        return np.where(places >= 0, x[:, np.maximum(places, 0)], 0.0)

    return over(volumes, kernel, keys)
