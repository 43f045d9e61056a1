"""Moving runs onto a template: by whole voxels, so that a run's centre of mass falls on the template's, or by a similarity (rotation, scale, shift) that is fitted to the run's mean image.

A similarity is fitted by damped Gauss-Newton steps over seven parameters, from coarse images to fine, to the correlation with the template (gain and offset are fitted along), in passes with one
mask each. Images are moved once, by trilinear values at the last transform; each pass refines the transform of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.functions.scalars import safe_div
from volumetra.operators import batches, packed


def _masses(volumes: DataFrame, shape: packed.Shape, keys: tuple[str, ...], mask: list[int] | None) -> DataFrame:
    """keys, m, x, y, z of each volume: the mass of its positive voxels (within the mask, numbers of voxels, if there is one) and its sums times x, y and z."""
    at = batches.cells(shape).astype(float)
    within = np.ones(len(at)) if mask is None else np.isin(np.arange(len(at)), list(mask)).astype(float)
    weigh = np.hstack([np.ones((len(at), 1)), at]) * within[:, None]
    each = batches.over(volumes, lambda x: np.maximum(np.nan_to_num(x), 0) @ weigh, keys)
    return each.select(*keys, *[F.get("voxels", F.lit(i)).alias(c) for i, c in enumerate("mxyz")])


def centres(volumes: DataFrame, shape: packed.Shape, keys: tuple[str, ...] = ("run",), mask: list[int] | None = None) -> DataFrame:
    """keys, cx, cy, cz: the centre of mass of all volumes with one key; null without mass."""
    total = _masses(volumes, shape, keys, mask).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in "mxyz"])
    return total.select(*keys, *[safe_div(F.col(c), F.when(F.col("m") > 0, F.col("m"))).alias(f"c{c}") for c in "xyz"])


def shifts(volumes: DataFrame, template: DataFrame, shape: packed.Shape, keys: tuple[str, ...] = ("run",), mask: list[int] | None = None) -> DataFrame:
    """keys, dx, dy, dz: whole voxels from each run's centre to the template's (one row with voxels); 0 where either has no mass."""
    goal = centres(template.select("voxels").withColumn("one", F.lit(1)), shape, ("one",), mask).select(*[F.col(f"c{c}").alias(f"t{c}") for c in "xyz"])
    own = centres(volumes, shape, keys, mask).join(F.broadcast(goal))  # one row
    return own.select(*keys, *[F.coalesce(F.round(F.col(f"t{c}") - F.col(f"c{c}")), F.lit(0.0)).cast("long").alias(f"d{c}") for c in "xyz"])


def by_centre(volumes: DataFrame, template: DataFrame, shape: packed.Shape, keys: tuple[str, ...] = ("run",), passes: tuple = (None,)) -> DataFrame:
    """``volumes`` moved onto the template, pass after pass, each with its mask (None: all voxels); volumes are only dealt if there are more runs than are sent to each task."""
    out = volumes
    for mask in passes:
        moved = out.join(shifts(out, template, shape, keys, mask), list(keys))
        out = batches.shift(moved, shape, keys=[c for c in volumes.columns if c != "voxels"])
    return out


def statistics(moved: DataFrame) -> DataFrame:
    """One row about the shifts of all runs: sum, mean, deviation and median of the distance moved."""
    d = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    return moved.agg(F.sum(d).alias("total"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.median(d).alias("median"))


#: Rows of transforms, one a run, that may be sent to every task.
MOST_RUNS = 100_000
#: Volumes of so many runs are added up in a task before what there is goes on.
HELD_RUNS = 32
#: Boxes over which images are averaged before they are matched, and steps at each size.
SCALES = ((4, 30), (2, 20), (1, 12))


def matrix(p: np.ndarray, shape: packed.Shape) -> np.ndarray:
    """The 3 x 4 matrix of a similarity from three angles, the logarithm of the scale and three steps, about the middle of the volume: where a voxel of the template lies in the image."""
    (a, b, c), turn = p[:3], np.eye(3)
    for axis, angle in enumerate((a, b, c)):
        i, j = [k for k in range(3) if k != axis]
        r = np.eye(3)
        r[i, i] = r[j, j] = np.cos(angle)
        r[i, j], r[j, i] = -np.sin(angle), np.sin(angle)
        turn = turn @ r
    linear, middle = np.exp(p[3]) * turn, (np.array(shape) - 1) / 2
    return np.hstack([linear, (middle + p[4:] - linear @ middle)[:, None]])


def sampled(volume: np.ndarray, points: np.ndarray, slopes: bool = False):
    """Trilinear values of a volume (x, y, z) at points (n, 3), 0 outside; with their slopes along x, y and z if asked for."""
    low = np.floor(points)
    part, low = points - low, low.astype(np.int64)
    value, slope = np.zeros(len(points)), np.zeros((len(points), 3)) if slopes else None
    limits = np.array(volume.shape)
    for corner in np.ndindex(2, 2, 2):
        at = low + corner
        inside = ((at >= 0) & (at < limits)).all(axis=1)
        v = np.where(inside, volume[tuple(np.where(inside, at[:, k], 0) for k in range(3))], 0.0)
        w = [part[:, k] if corner[k] else 1 - part[:, k] for k in range(3)]
        value += v * w[0] * w[1] * w[2]
        if slopes:
            for k in range(3):
                a, b = [j for j in range(3) if j != k]
                slope[:, k] += (v if corner[k] else -v) * w[a] * w[b]
    return (value, slope) if slopes else value


def _smaller(volume: np.ndarray, by: int) -> np.ndarray:
    n = [s // by for s in volume.shape]
    return volume[tuple(slice(0, k * by) for k in n)].reshape(n[0], by, n[1], by, n[2], by).mean(axis=(1, 3, 5))


def _smooth(volume: np.ndarray) -> np.ndarray:
    """Weights 1, 2, 1 along each axis, so that coarse images have no steps."""
    for axis in range(3):
        v = np.pad(volume, [(1, 1) if k == axis else (0, 0) for k in range(3)], mode="edge")
        n, cut = volume.shape[axis], [slice(None)] * 3
        parts = [v[tuple(cut[:axis] + [slice(i, i + n)] + cut[axis + 1 :])] for i in range(3)]
        volume = (parts[0] + 2 * parts[1] + parts[2]) / 4
    return volume


def _step(p: np.ndarray, image: np.ndarray, goal: np.ndarray, points: np.ndarray, full: packed.Shape, by: int):
    """(mean cost, normal matrix, right side) of the image at ``p`` against the goal: template = gain * image + offset, whose gain and offset are fitted along with the
    seven parameters. Beyond its border an image goes on as it is there."""
    near = lambda q: points @ q[:, :3].T + q[:, 3]
    here, n = near(matrix(p, full)), len(points)
    small = (here - (by - 1) / 2) / by
    held = np.clip(small, 0, np.array(image.shape) - 1)
    value, slope = sampled(image, held, True)
    slope = np.where(held == small, slope, 0.0)
    base = np.stack([value, np.ones(n)], axis=1)
    gain, offset = np.linalg.lstsq(base, goal, rcond=None)[0]
    off = gain * value + offset - goal
    steps = []
    for k in range(7):
        q = p.copy()
        q[k] += 1e-5
        steps.append((gain * slope / by * (near(matrix(q, full)) - here)).sum(axis=1) / 1e-5)
    j = np.hstack([np.stack(steps, axis=1), base])
    return float(off @ off) / n, j.T @ j / n, j.T @ off / n


def fitted(image: np.ndarray, template: np.ndarray, mask: np.ndarray | None, start: np.ndarray) -> tuple[np.ndarray, float]:
    """(parameters, correlation) of the similarity that brings the image onto the template within the mask: damped Gauss-Newton steps from coarse to fine."""
    shape, p = template.shape, start.astype(float)
    goal = points = None
    for by, steps in SCALES:
        if by > 1 and min(shape) // by < 4:
            continue
        small, target = _smaller(image, by), _smaller(template, by)
        if by > 1:
            small, target = _smooth(small), _smooth(target)
        inside = np.ones(target.shape, bool) if mask is None else _smaller(mask.astype(float), by) > 0.5
        if inside.sum() < 50:
            continue
        points, goal, damp = np.argwhere(inside) * by + (by - 1) / 2, target[inside], 1e-3
        if by == 1:  # from here on only what the image really shows
            q = matrix(p, shape)
            here = points @ q[:, :3].T + q[:, 3]
            shown = ((here >= 0) & (here <= np.array(shape) - 1)).all(axis=1)
            if 2 * shown.sum() >= len(points):
                points, goal = points[shown], goal[shown]
        cost, a, r = _step(p, small, goal, points, shape, by)
        for _ in range(steps):
            move = np.linalg.lstsq(a + damp * np.diag(np.diag(a)) + 1e-12 * np.eye(9), r, rcond=None)[0]
            new = p - move[:7]
            try_cost, try_a, try_r = _step(new, small, goal, points, shape, by)
            if try_cost < cost:
                done = cost - try_cost < 1e-9 * cost
                p, cost, a, r, damp = new, try_cost, try_a, try_r, damp / 4
                if done:
                    break
            else:
                damp *= 8
                if damp > 1e8:
                    break
    return p, 0.0 if goal is None else _alike(p, image, template, points)


def _alike(p: np.ndarray, image: np.ndarray, template: np.ndarray, points: np.ndarray) -> float:
    """The correlation of the image at ``p`` with the template, over the points that lie inside the image."""
    q = matrix(p, image.shape)
    here = points @ q[:, :3].T + q[:, 3]
    inside = ((here >= 0) & (here <= np.array(image.shape) - 1)).all(axis=1)
    value, goal = sampled(image, here[inside]), sampled(template, points[inside])
    spread = value.std() * goal.std() if len(goal) else 0.0
    return float(((value - value.mean()) * (goal - goal.mean())).mean() / spread) if spread else 0.0


def run_sums(volumes: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """(keys, voxels, n): sums of the volumes of each run and task, a few rows a run whatever its number of volumes. Missing voxels count as 0."""
    kinds = {f.name: f.dataType.simpleString() for f in volumes.schema}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def rows():
            for key, (total, n) in held.items():
                own = [pa.array([k], part.schema.field(c).type) for k, c in zip(key, keys)]
                yield pa.RecordBatch.from_arrays([*own, batches.arrays(total[None, :]), pa.array([n])], names=[*keys, "voxels", "n"])
            held.clear()

        for part, x in batches.blocks(parts, "voxels"):
            own = list(zip(*[part.column(c).to_pylist() for c in keys]))
            for key in dict.fromkeys(own):
                at = [i for i, k in enumerate(own) if k == key]
                if key not in held and len(held) == HELD_RUNS:
                    yield from rows()
                total = held.setdefault(key, [0.0, 0])
                total[0], total[1] = total[0] + np.nan_to_num(x[at]).sum(axis=0), total[1] + len(at)
        if held:
            yield from rows()

    return volumes.select(*keys, "voxels").mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["voxels array<double>", "n long"]))


def similarity(volumes: DataFrame, template: np.ndarray, shape: packed.Shape, keys: tuple[str, ...] = ("run",), masks: Sequence[np.ndarray | None] = (None,)) -> DataFrame:
    """(keys, pass, matrix, correlation): the transform of each run's mean image onto the template (voxels), refined pass after pass, each within its mask (None: everywhere).

    The mean images are sums over tasks, so a run may have any number of volumes; what is fitted in a task is one image. Transforms of a later pass start from those of the one before, and replace them.
    """
    goal = np.nan_to_num(np.asarray(template, float)).reshape(shape)
    inside = [None if m is None else np.asarray(m, bool).reshape(shape) for m in masks]
    sent = volumes.sparkSession.sparkContext.broadcast((goal, inside))  # a few images
    sums = run_sums(volumes, keys)
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}

    def one(t: pa.Table) -> pa.Table:
        goal_, masks_ = sent.value
        image, n = np.zeros(goal_.shape), 0
        for row, k in zip(t["voxels"], t["n"].to_pylist()):
            image += np.array(row.values).reshape(goal_.shape)
            n += k
        p, out = np.zeros(7), []
        for i, mask in enumerate(masks_):
            p, fit = fitted(image / n, goal_, mask, p)
            out.append((i, matrix(p, goal_.shape).ravel().tolist(), fit))
        own = [pa.array([t[k][0].as_py()] * len(out), t.schema.field(k).type) for k in keys]
        passes, matrices, fits = zip(*out)
        return pa.table([*own, pa.array(passes, pa.int32()), pa.array(matrices, pa.list_(pa.float64())), pa.array(fits)], [*keys, "pass", "matrix", "correlation"])

    return sums.groupBy(*keys).applyInArrow(one, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["`pass` int, matrix array<double>, correlation double"]))


def last_pass(transforms: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """(keys, matrix) of each run's last pass."""
    return transforms.groupBy(*keys).agg(F.max_by("matrix", "pass").alias("matrix"))


def resample(volumes: DataFrame, transforms: DataFrame, shape: packed.Shape, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """``volumes`` with each voxel taken, trilinearly, from where its run's ``matrix`` (12 numbers, row by row) says; 0 outside.

    The transforms are one small row a run. Up to ``MOST_RUNS`` they are sent to every task; beyond, they are joined by an exchange.
    """
    spark = volumes.sparkSession
    few = transforms.select(*keys, "matrix").limit(MOST_RUNS + 1).collect()
    if len(few) <= MOST_RUNS:
        transforms = F.broadcast(spark.createDataFrame(few, transforms.select(*keys, "matrix").schema))
    both = volumes.join(transforms.select(*keys, "matrix"), list(keys))
    at = batches.cells(shape)

    def kernel(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        q = m.reshape(-1, 3, 4)
        return np.stack([sampled(np.nan_to_num(v).reshape(shape), at @ w[:, :3].T + w[:, 3]).ravel() for v, w in zip(x, q)])

    return batches.over(both, kernel, [c for c in volumes.columns if c != "voxels"], ("matrix",), voxel_bytes=64)


def by_similarity(volumes: DataFrame, template: np.ndarray, shape: packed.Shape, keys: tuple[str, ...] = ("run",), masks: Sequence[np.ndarray | None] = (None,)) -> tuple[DataFrame, DataFrame]:
    """(``volumes`` on the template, transforms by run and pass). Volumes are resampled once, by the last pass."""
    transforms = similarity(volumes, template, shape, keys, masks)
    return resample(volumes, last_pass(transforms, keys), shape, keys), transforms


def transform_statistics(transforms: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """keys, pass, total, mean, std and median of the twelve numbers of each transform. No exchange: the arrays have a fixed size."""
    m, n = F.col("matrix"), F.lit(12)
    total = F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
    spread = lambda mean: F.sqrt(F.aggregate(m, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    middle = F.sort_array(m)
    return transforms.select(*keys, "pass", total.alias("total"), (total / n).alias("mean"), spread(total / n).alias("std"), ((F.get(middle, F.lit(5)) + F.get(middle, F.lit(6))) / 2).alias("median"))
