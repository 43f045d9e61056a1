"""Voxel grids in long form (tr, x, y, z, v): normalisation over time and space, masks, crops and reports. Shifts, turns and kernels are in ``packed``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volumetra.functions.scalars import clip, safe_div, whole_div
from volumetra.operators import exact


def normalize(voxels: DataFrame, robust: bool = False, bound: float = 5.0, zero: float = 0.001, refined: bool = False) -> DataFrame:
    """Per voxel over time, then per TR over space, clipped at ``bound`` deviations of the run; values near 0 or not finite are missing and end as 0.

    ``refined``: medians by refinement, for runs of any length, where a window would hold all values of a voxel. The run's deviation is a sum over partial sums that is joined back, so no task gets a whole run.
    """
    finite = ~F.isnan("v") & (F.abs("v") != float("inf"))
    v = voxels.withColumn("n", F.when(finite & (F.abs("v") >= zero), F.col("v")))
    time, space = Window.partitionBy("run", "vox"), Window.partitionBy("run", "tr")
    if robust and refined:
        v = exact.robust_scores(v)
    elif robust:
        v = v.withColumn("m", F.median("n").over(time)).withColumn("d", F.median(F.abs(F.col("n") - F.col("m"))).over(time))
        v = v.withColumn("n", safe_div(F.col("n") - F.col("m"), F.col("d")))
    else:
        v = v.withColumn("n", safe_div(F.col("n") - F.avg("n").over(time), F.stddev_pop("n").over(time)))
    v = v.withColumn("n", safe_div(F.col("n") - F.avg("n").over(space), F.stddev_pop("n").over(space)))
    v = v.select("run", "tr", "vox", "n")
    spread = v.groupBy("run").agg(F.stddev_pop("n").alias("spread"))
    clipped = v.join(spread, "run").withColumn("n", clip(F.col("n"), bound * F.col("spread")))
    return clipped.select("run", "tr", "vox", F.coalesce("n", F.lit(0.0)).alias("v"))


def crop(g: DataFrame, x: tuple, y: tuple, z: tuple) -> DataFrame:
    """Half-open box, moved to the origin."""
    inside = reduce(lambda a, b: a & b, [(F.col(c) >= lo) & (F.col(c) < hi) for c, (lo, hi) in zip("xyz", (x, y, z))])
    return g.where(inside).withColumns({c: F.col(c) - lo for c, (lo, _) in zip("xyz", (x, y, z))})


def stack(first: DataFrame, second: DataFrame, extent: int) -> DataFrame:
    return first.unionByName(second.withColumn("x", F.col("x") + extent))


def fill_outside(g: DataFrame, mask: DataFrame, value: float = 0.0) -> DataFrame:
    """Voxels that the mask (x, y, z) lacks get ``value``. The planner broadcasts the mask if it is small."""
    m = mask.select("x", "y", "z", F.lit(1).alias("__in"))
    return g.join(m, ["x", "y", "z"], "left").withColumn("v", F.when(F.col("__in").isNull(), value).otherwise(F.col("v"))).drop("__in")


def edges(mask: DataFrame) -> DataFrame:
    """One row about a mask (x, y, z): its bounding box, the midpoint of its x range, and the middle of the widest gap in x (the first of the widest),
    where the eyes part.

    The gap is looked for among the distinct x of the mask, at most one row a plane of the grid.
    """
    box = mask.agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]).withColumn("mid", F.expr("x_min + (x_max - x_min) div 2"))
    planes = mask.select("x").distinct().agg(F.array_sort(F.collect_list("x")).alias("xs"))
    gaps = F.transform(F.slice("xs", F.lit(2), F.size("xs")), lambda x, i: F.struct((x - F.get("xs", i)).alias("gap"), (-x).alias("first"),
        whole_div(F.get("xs", i) + x, 2).alias("mid")))
    return box.join(planes.select(F.array_max(gaps)["mid"].alias("gap_mid")))  # one row each


def cut_eyes(g: DataFrame, mask: DataFrame, value: float = 0.0, keys: tuple[str, ...] = ("tr",)) -> DataFrame:
    """The two eyes of a grid (keys, x, y, z, v): outside the mask ``value``, cropped to the mask's box, the half from its gap on first, then the half before it.

    Boxes are half-open, as in ``crop``: the last plane of each axis goes. The mask and its edges are small tables, which the planner broadcasts.
    """
    e = edges(mask).select("x_min", "x_max", "y_min", "y_max", "z_min", "z_max", F.coalesce("gap_mid", "mid").alias("part"))
    c = F.col
    inside = (c("y") >= c("y_min")) & (c("y") < c("y_max")) & (c("z") >= c("z_min")) & (c("z") < c("z_max")) & (c("x") >= c("x_min")) & (c("x") < c("x_max"))
    cut = fill_outside(g, mask, value).join(F.broadcast(e)).where(inside)  # one row
    right = c("x") >= c("part")
    x = F.when(right, c("x") - c("part")).otherwise(c("x") - c("x_min") + c("x_max") - c("part"))
    return cut.select(*keys, x.alias("x"), (c("y") - c("y_min")).alias("y"), (c("z") - c("z_min")).alias("z"), "v")


def voxel_report(g: DataFrame, at: tuple[int, int, int], bins: int = 75) -> DataFrame:
    """(part, a, b, v): the data of a quality report: three slices through ``at`` of the mean volume, mean projections along each axis, the scaled time course and a histogram of positive values."""
    cube = g.groupBy("x", "y", "z").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    none = F.lit(None).cast("long")
    parts = []
    for axis, k in zip("xyz", at):
        a, b = [c for c in "xyz" if c != axis]
        parts.append(cube.where(F.col(axis) == k).select(F.lit(f"slice {axis}").alias("part"), F.col(a).alias("a"), F.col(b).alias("b"),
            safe_div(F.col("s"), F.col("n")).alias("v")))
        parts.append(cube.groupBy(F.lit(f"mean {axis}").alias("part"), F.col(a).alias("a"), F.col(b).alias("b")).agg(safe_div(F.sum("s"), F.sum("n")).alias("v")))
    course = g.groupBy("tr").agg(F.avg("v").alias("m"))
    ends = F.broadcast(course.agg(F.min("m").alias("low"), F.max("m").alias("high")))  # one row
    scaled = safe_div(F.col("m") - F.col("low"), F.col("high") - F.col("low")).alias("v")
    parts.append(course.join(ends).select(F.lit("course").alias("part"), F.col("tr").alias("a"), none.alias("b"), scaled))
    positive = g.where("v > 0").select("v")
    bounds = positive.agg(F.min("v").alias("lo"), ((F.max("v") - F.min("v")) / bins).alias("w"))  # one row
    counted = positive.join(F.broadcast(bounds)).groupBy(F.least(F.floor(safe_div(F.col("v") - F.col("lo"), F.col("w"))),
        F.lit(bins - 1)).alias("a")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    parts.append(counted.select(F.lit("histogram").alias("part"), "a", none.alias("b"), "v"))
    return reduce(lambda x, y: x.unionByName(y), parts)


def group_norm(voxels: DataFrame, per_group: int, eps: float = 1e-5) -> DataFrame:
    """Groups are contiguous slabs of the flattened sample."""
    w = Window.partitionBy("tr", "grp")
    g = voxels.withColumn("grp", F.expr(f"vox div {per_group}"))
    return g.select("tr", "vox", "grp", ((F.col("v") - F.avg("v").over(w)) / F.sqrt(F.var_pop("v").over(w) + eps)).alias("v"))


def minmax_course(voxels: DataFrame) -> DataFrame:
    """The run's mean course over time, scaled to [0, 1]."""
    w = Window.partitionBy("run")
    c = voxels.groupBy("run", "tr").agg(F.avg("v").alias("m"))
    low = F.min("m").over(w)
    return c.select("run", "tr", safe_div(F.col("m") - low, F.max("m").over(w) - low).alias("v"))
