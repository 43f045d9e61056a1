"""Volumes as one array a row: crops, shifts, turns, pools and kernels without an exchange.

A volume of shape (nx, ny, nz) is an array of its voxels with z fastest, y next, x slowest, as sources and predictors hold it. Each function makes
one column from such an array, voxel by voxel with built-in array functions, so a whole chain of them stays in one stage whatever the number of volumes. What lies outside
the source takes ``fill``; null voxels stay null. Indices that fall outside are never wrapped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.functions.scalars import mish, whole_div

Shape = tuple[int, int, int]
Place = Callable[[Column, Column, Column], tuple[Column, Column, Column]]


def size(shape: Shape) -> int:
    return shape[0] * shape[1] * shape[2]


def place(i: Column, shape: Shape) -> tuple[Column, Column, Column]:
    """x, y, z of the voxel with number i."""
    _, ny, nz = shape
    return whole_div(i, ny * nz), whole_div(i, nz) % ny, i % nz


def voxel(voxels: Column, shape: Shape, x: Column, y: Column, z: Column, fill: float | None = 0.0) -> Column:
    nx, ny, nz = shape
    inside = (x >= 0) & (x < nx) & (y >= 0) & (y < ny) & (z >= 0) & (z < nz)
    return F.when(inside, F.get(voxels, (x * (ny * nz) + y * nz + z).cast("int"))).otherwise(F.lit(fill))


def _each(n: int, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def remap(voxels: Column, shape: Shape, target: Shape, source: Place, fill: float | None = 0.0) -> Column:
    """Each voxel of the target takes the source voxel that ``source(x, y, z)`` names."""
    return _let(voxels, lambda v: _each(size(target), lambda i: voxel(v, shape, *source(*place(i, target)), fill)))


def crop(voxels: Column, shape: Shape, low: Shape, high: Shape) -> Column:
    """Half-open box, moved to the origin."""
    return remap(voxels, shape, tuple(h - s for s, h in zip(low, high)), lambda x, y, z: (x + low[0], y + low[1], z + low[2]))


def stack(first: Column, second: Column) -> Column:
    """Two volumes of equal ny and nz, one after the other along x."""
    return F.concat(first, second)


def pad(voxels: Column, shape: Shape, by: int, fill: float = 0.0) -> Column:
    return remap(voxels, shape, tuple(n + 2 * by for n in shape), lambda x, y, z: (x - by, y - by, z - by), fill)


def shift(voxels: Column, shape: Shape, dx, dy, dz, fill: float = 0.0) -> Column:
    """Moved by whole voxels; the steps may be columns, so each row has its own."""
    return remap(voxels, shape, shape, lambda x, y, z: (x - dx, y - dy, z - dz), fill)


def _nearest(v: Column) -> Column:
    """The whole number a coordinate belongs to; rounded to nine places first, so that engines agree on what lies halfway."""
    return F.floor(F.round(v, 9) + 0.5)


def zoom(voxels: Column, shape: Shape, factor, fill: float = 0.0) -> Column:
    """Nearest neighbour about the centre, same shape; a factor under 1 leaves a border of ``fill``."""
    at = lambda v, n: _nearest((v - (n - 1) / 2) / factor + (n - 1) / 2)
    return remap(voxels, shape, shape, lambda *p: tuple(at(v, n) for v, n in zip(p, shape)), fill)


def rotate(voxels: Column, shape: Shape, degrees, axis: int, fill: float = 0.0) -> Column:
    """Nearest neighbour about the centre in the plane of the two other axes, same shape; any angle, which may be a column."""
    a, b = [k for k in range(3) if k != axis]
    angle = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    ca, cb = (shape[a] - 1) / 2, (shape[b] - 1) / 2

    def source(*p: Column):
        u, v = p[a] - ca, p[b] - cb
        out = list(p)
        out[a] = _nearest(F.cos(angle) * u + F.sin(angle) * v + ca)
        out[b] = _nearest(F.cos(angle) * v - F.sin(angle) * u + cb)
        return tuple(out)

    return remap(voxels, shape, shape, source, fill)


def drawn(key: Column, salt: int, low: int, high: int) -> Column:
    """A whole number from low to high that depends on the row's key alone, by arithmetic any engine can replay."""
    return ((key * 7919 + 104729 * salt + 13) % 100003) % (high - low + 1) + low


def augment(volumes: DataFrame, shape: Shape, rotation: int = 0, shifts: int = 0, zooms: int = 0, key: str = "tr", voxels: str = "voxels") -> DataFrame:
    """``volumes`` with each volume turned about x, y and z by up to ``rotation`` degrees, moved by up to ``shifts`` voxels and zoomed by up to
    ``zooms`` per cent, in this order; the parameters are drawn from the row's key, and a bound of 0 leaves its step out."""
    k, out = F.col(key), volumes
    if rotation:
        for axis in range(3):
            out = out.withColumn(voxels, rotate(F.col(voxels), shape, drawn(k, axis, -rotation, rotation).cast("double"), axis))
    if shifts:
        out = out.withColumn(voxels, shift(F.col(voxels), shape, *[drawn(k, 3 + a, -shifts, shifts) for a in range(3)]))
    if zooms:
        out = out.withColumn(voxels, zoom(F.col(voxels), shape, 1 + drawn(k, 6, -zooms, zooms) / F.lit(100.0)))
    return out


def upsample(voxels: Column, shape: Shape, by: int = 2) -> Column:
    return remap(voxels, shape, tuple(n * by for n in shape), lambda *p: tuple(whole_div(v, by) for v in p))


def pool(voxels: Column, shape: Shape, by: int = 2) -> Column:
    """Mean over boxes of ``by`` voxels a side; what is left over at the end of an axis is dropped."""
    target = tuple(n // by for n in shape)
    steps = [(a, b, c) for a in range(by) for b in range(by) for c in range(by)]

    def mean(v: Column, i: Column) -> Column:
        x, y, z = place(i, target)
        return reduce(lambda s, d: s + voxel(v, shape, x * by + d[0], y * by + d[1], z * by + d[2]), steps, F.lit(0.0)) / by**3

    return _let(voxels, lambda v: _each(size(target), lambda i: mean(v, i)))


def convolve(channels: Sequence[Column], shape: Shape, weights: Sequence[Sequence[float]], bias: float = 0.0) -> Column:
    """One output channel: for each input channel 27 weights, x slowest, over the neighbours from -1 to 1; outside counts as 0."""
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]

    def total(own: Column, i: Column) -> Column:
        x, y, z = place(i, shape)
        parts = [voxel(own[f"c{k}"], shape, x + a, y + b, z + c) * float(w) for k, row in enumerate(weights) for (a, b, c), w in zip(steps, row) if w]
        return reduce(lambda s, p: s + p, parts, F.lit(float(bias)))

    every = F.struct(*[v.alias(f"c{k}") for k, v in enumerate(channels)])
    return _let(every, lambda own: _each(size(shape), lambda i: total(own, i)))


def group_norm(voxels: Column, n: int, groups: int, gamma: Sequence[float] | None = None, beta: Sequence[float] | None = None, eps: float = 1e-5) -> Column:
    """Groups are contiguous slabs of the flattened sample; ``gamma`` and ``beta`` scale and move each group."""
    per = n // groups
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / per

    def one(own: Column, g: int) -> Column:
        scale, move = float(gamma[g]) if gamma else 1.0, float(beta[g]) if beta else 0.0
        centred = _let(F.struct(own.alias("a"), mean(own).alias("m")), lambda x: F.transform(x["a"], lambda v: v - x["m"]))
        spread = _let(centred, lambda a: F.struct(a.alias("a"), (F.lit(scale) / F.sqrt(mean(F.transform(a, lambda v: v * v)) + eps)).alias("s")))
        return _let(spread, lambda x: F.transform(x["a"], lambda v: v * x["s"] + move))

    return _let(voxels, lambda v: F.concat(*[one(F.slice(v, g * per + 1, per), g) for g in range(groups)]))


def dense(values: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """An array of one weighted sum for each row of ``weights``."""
    matrix = [F.array(*[F.lit(float(w)) for w in row]) for row in weights]
    product = lambda own, row: F.aggregate(F.zip_with(own, row, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return _let(values, lambda own: F.array(*[product(own, row) + float(bias[k] if bias else 0.0) for k, row in enumerate(matrix)]))


def activate(values: Column) -> Column:
    return F.transform(values, mish)


def residual(voxels: Column, shape: Shape, groups: int, first: Sequence[float], second: Sequence[float]) -> Column:
    """norm, mish, convolve; twice; plus the input."""

    def added(v: Column) -> Column:
        out = v
        for weights in (first, second):
            out = convolve([activate(group_norm(out, size(shape), groups))], shape, [weights])
        return F.zip_with(out, v, lambda a, b: a + b)

    return _let(voxels, added)


def with_channel(voxels: Column) -> Column:
    """Each voxel as an array of one channel."""
    return F.transform(voxels, lambda v: F.array(v))


def downsample(voxels: Column, shape: Shape, weights: Sequence[float], groups: int) -> Column:
    """Convolve, norm, mish and pool to half the size."""
    return pool(activate(group_norm(convolve([voxels], shape, [weights]), size(shape), groups)), shape)


def long_form(volumes: DataFrame, shape: Shape, keys: Sequence[str] = ("tr",), voxels: str = "voxels") -> DataFrame:
    """keys, x, y, z, v: one row a voxel."""
    v = volumes.select(*keys, F.posexplode(voxels).alias("i", "v"))
    return v.select(*keys, *[p.cast("long").alias(c) for c, p in zip("xyz", place(F.col("i"), shape))], F.col("v").cast("double").alias("v"))


def pack(grid: DataFrame, shape: Shape, keys: Sequence[str] = ("tr",), fill: float = 0.0) -> DataFrame:
    """keys, voxels from rows keys, x, y, z, v; voxels that no row has, or only null, get ``fill``. One exchange by the keys.

    The cells of a volume and one filler for each of its places are sorted once; the first of each place counts.
    """
    _, ny, nz = shape
    number = (F.col("x") * (ny * nz) + F.col("y") * nz + F.col("z")).cast("int")
    cells = grid.groupBy(*keys).agg(F.collect_list(F.when(F.col("v").isNotNull(), F.struct(number.alias("i"), F.lit(0).alias("k"), F.col("v").cast("double").alias("v")))).alias("own"))
    fillers = F.transform(F.sequence(F.lit(0), F.lit(size(shape) - 1)), lambda i: F.struct(i.alias("i"), F.lit(1).alias("k"), F.lit(float(fill)).alias("v")))
    first = lambda a: F.filter(a, lambda c, j: (j == 0) | (F.get(a, j - 1)["i"] != c["i"]))
    inside = F.filter(F.concat("own", fillers), lambda c: (c["i"] >= 0) & (c["i"] < size(shape)))
    return cells.select(*keys, _let(F.sort_array(inside), lambda a: F.transform(first(a), lambda c: c["v"])).alias("voxels"))
