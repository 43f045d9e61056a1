"""Queries over packed volumes: each embedding is a 4 x 4 x 4 grid. None of them has an exchange but those that say so."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.operators import batches, network, packed, predict, register, volume
from volumetra.plans.registry import C, V, query, rounded
from volumetra.sources.tables import grid, packed_volumes

SHAPE = (4, 4, 4)
_FLAT = "e AS (SELECT CAST(label AS BIGINT) AS run, vec_id AS tr, embedding AS a FROM embeddings)"


def _long(spark: SparkSession, sf_dir: str, made: Column, shape=SHAPE, digits: int = 6) -> DataFrame:
    v = packed_volumes(spark, sf_dir).select("tr", made.alias("voxels"))
    return packed.long_form(v, shape).withColumn("v", F.round("v", digits))


def _run(spark: SparkSession, sf_dir: str, layers: list[network.Layer], weights: dict) -> DataFrame:
    """(tr, voxels): a network in doubles over the packed volumes."""
    return network.run(packed_volumes(spark, sf_dir), network.Network(layers, weights, SHAPE, np.float64))


def _long_run(spark: SparkSession, sf_dir: str, layers: list[network.Layer], weights: dict, shape=SHAPE, digits: int = 6) -> DataFrame:
    return packed.long_form(_run(spark, sf_dir, layers, weights), shape).withColumn("v", F.round("v", digits))


def _kernel(weights: list[list[float]], bias: float = 0.0) -> dict:
    """One output channel from 27 weights for each input channel."""
    k = np.array(weights, float)
    return {"kernel": k.T.reshape(3, 3, 3, len(k), 1), "bias": np.array([bias])}


_CONV = ("conv", {"kernel": 3, "filters": 1})


def _remapped(size: int, x: str, y: str, z: str) -> str:
    return f"""WITH {C},
    t AS (SELECT tr, i // {size * size} AS x, (i // {size}) % {size} AS y, i % {size} AS z FROM (SELECT DISTINCT tr FROM c), (SELECT unnest(range(0, {size**3})) AS i))
    SELECT t.tr, t.x, t.y, t.z, round(coalesce(c.v, 0), 6) AS v FROM t LEFT JOIN c ON c.tr = t.tr AND c.x = {x} AND c.y = {y} AND c.z = {z}"""


@query(_remapped(6, "t.x - 1", "t.y - 1", "t.z - 1"))
def pad_grid(spark, sf_dir):
    return _long(spark, sf_dir, packed.pad(F.col("voxels"), SHAPE, 1), (6, 6, 6))


@query(_remapped(4, "t.x - 1", "t.y + 1", "t.z - 2"))
def shift_fill(spark, sf_dir):
    return _long(spark, sf_dir, packed.shift(F.col("voxels"), SHAPE, 1, -1, 2))


def _step(k: int) -> str:
    return f"((t.tr * 7919 + {104729 * (3 + k)} + 13) % 100003) % 5 - 2"


@query(_remapped(4, *[f"t.{c} - ({_step(k)})" for k, c in enumerate("xyz")]))
def shift_each(spark, sf_dir):
    """Each volume by steps of its own, from -2 to 2."""
    return _long(spark, sf_dir, packed.shift(F.col("voxels"), SHAPE, *[packed.drawn(F.col("tr"), 3 + k, -2, 2) for k in range(3)]))


def _zoomed(c: str, factor: str) -> str:
    return f"CAST(floor(round(({c} - 1.5::DOUBLE) / {factor} + 1.5::DOUBLE, 9) + 0.5::DOUBLE) AS BIGINT)"


@query(_remapped(4, *[_zoomed(f"t.{c}", "0.5::DOUBLE") for c in "xyz"]))
def zoom_shrink(spark, sf_dir):
    return _long(spark, sf_dir, packed.zoom(F.col("voxels"), SHAPE, 0.5))


@query(_remapped(4, *[_zoomed(f"t.{c}", "1.7::DOUBLE") for c in "xyz"]))
def zoom_enlarge(spark, sf_dir):
    return _long(spark, sf_dir, packed.zoom(F.col("voxels"), SHAPE, 1.7))


def _turned(a: str, b: str, angle: str) -> tuple[str, str]:
    u, v = f"({a} - 1.5::DOUBLE)", f"({b} - 1.5::DOUBLE)"
    near = lambda x: f"CAST(floor(round({x} + 1.5::DOUBLE, 9) + 0.5::DOUBLE) AS BIGINT)"
    return near(f"cos({angle}) * {u} + sin({angle}) * {v}"), near(f"cos({angle}) * {v} - sin({angle}) * {u}")


@query(_remapped(4, *_turned("t.x", "t.y", "radians(33::DOUBLE)"), "t.z"))
def rotate_nearest(spark, sf_dir):
    """By 33 degrees in the plane of x and y."""
    return _long(spark, sf_dir, packed.rotate(F.col("voxels"), SHAPE, 33, 2))


@query(_remapped(4, *_turned("t.x", "t.y", "radians(90::DOUBLE)"), "t.z"))
def rotate_quarter(spark, sf_dir):
    return _long(spark, sf_dir, packed.rotate(F.col("voxels"), SHAPE, 90, 2))


def _drawn(salt: int, bound: int) -> str:
    return f"(((tr * 7919 + {104729 * salt} + 13) % 100003) % {2 * bound + 1} - {bound})"


def _augmented() -> str:
    """Each step as a relation of its own: where each voxel of its result comes from."""
    steps, before = [], "c"

    def step(x: str, y: str, z: str) -> None:
        nonlocal before
        after = f"s{len(steps)}"
        steps.append(f"{after} AS (SELECT t.tr, t.x, t.y, t.z, coalesce(b.v, 0) AS v FROM t LEFT JOIN {before} b ON b.tr = t.tr AND b.x = {x} AND b.y = {y} AND b.z = {z})")
        before = after

    at = [f"t.{c}" for c in "xyz"]
    for axis in range(3):
        a, b = [k for k in range(3) if k != axis]
        own = list(at)
        own[a], own[b] = _turned(at[a], at[b], f"radians(CAST({_drawn(axis, 20).replace('tr', 't.tr')} AS DOUBLE))")
        step(*own)
    step(*[f"{c} - {_drawn(3 + k, 1).replace('tr', 't.tr')}" for k, c in enumerate(at)])
    step(*[_zoomed(c, f"(1 + {_drawn(6, 30).replace('tr', 't.tr')} / 100::DOUBLE)") for c in at])
    cells = "t AS (SELECT tr, i // 16 AS x, (i // 4) % 4 AS y, i % 4 AS z FROM (SELECT DISTINCT tr FROM c), (SELECT unnest(range(0, 64)) AS i))"
    return f"WITH {C}, {cells}, {', '.join(steps)} SELECT tr, x, y, z, round(v, 6) AS v FROM {before}"


@query(_augmented())
def augment_each(spark, sf_dir):
    """Turned about three axes, moved and zoomed, with parameters drawn from each volume's key."""
    v = batches.augment(packed_volumes(spark, sf_dir), SHAPE, 20, 1, 30)
    return rounded(packed.long_form(v, SHAPE))


@query(f"WITH {C} SELECT tr, x // 2 AS x, y // 2 AS y, z // 2 AS z, round(avg(v), 6) AS v FROM c GROUP BY 1, 2, 3, 4")
def avg_pool(spark, sf_dir):
    return _long_run(spark, sf_dir, network.chain(("pool", {"by": 2})), {}, (2, 2, 2))


@query(
    f"WITH {C} SELECT a.tr, a.x, a.y, a.z, round(sum(b.v), 5) AS v FROM c a"
    " JOIN c b ON a.tr = b.tr AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 GROUP BY 1, 2, 3, 4"
)
def conv_small(spark, sf_dir):
    """A box kernel."""
    return _long_run(spark, sf_dir, network.chain(_CONV), {"conv0": _kernel([[1.0] * 27])}, digits=5)


def _weight(i: int, k: int) -> float:
    return ((i * 5 + k * 3) % 7 - 3) / 9.7


_W = "((((b.x - a.x + 1) * 9 + (b.y - a.y + 1) * 3 + b.z - a.z + 1) * 5 + {k} * 3) % 7 - 3) / 9.7::DOUBLE"


@query(
    f"WITH {C} SELECT a.tr, a.x, a.y, a.z, round(0.25::DOUBLE + sum(b.v * {_W.format(k=0)} + (b.v * b.v) * {_W.format(k=1)}), 5) AS v FROM c a"
    " JOIN c b ON a.tr = b.tr AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 GROUP BY 1, 2, 3, 4"
)
def conv_channels(spark, sf_dir):
    """A weighted kernel over two channels, the voxels and their squares, with a bias."""
    layers = [network.Layer("square", "square", ("input",)), network.Layer("both", "join", ("input", "square")), *network.chain(_CONV, start="both")]
    return _long_run(spark, sf_dir, layers, {"conv0": _kernel([[_weight(i, k) for i in range(27)] for k in range(2)], 0.25)}, digits=5)


@query(
    f"WITH {C} SELECT tr, 2 * x + i AS x, 2 * y + j AS y, 2 * z + k AS z, round(v, 6) AS v FROM c,"
    " (SELECT unnest(range(0, 2)) AS i), (SELECT unnest(range(0, 2)) AS j), (SELECT unnest(range(0, 2)) AS k)"
)
def upsample(spark, sf_dir):
    return _long(spark, sf_dir, packed.upsample(F.col("voxels"), SHAPE), (8, 8, 8))


_NORM = """SELECT tr, vox, vox // 8 AS grp, round({g} * (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 0.00001::DOUBLE) + {b}, 6) AS v
FROM v WINDOW w AS (PARTITION BY tr, vox // 8)"""


def _normed(spark: SparkSession, sf_dir: str, gamma=None, beta=None) -> DataFrame:
    parts = {"gamma": np.ones(8) if gamma is None else np.array(gamma), "beta": np.zeros(8) if beta is None else np.array(beta)}
    v = _run(spark, sf_dir, network.chain(("norm", {"groups": 8})), {"norm0": parts}).select("tr", F.posexplode("voxels").alias("vox", "v"))
    return rounded(v.select("tr", F.col("vox").cast("long").alias("vox"), F.expr("vox div 8").alias("grp"), "v"))


@query(f"WITH {V} " + _NORM.format(g="1", b="0"))
def group_norm(spark, sf_dir):
    return _normed(spark, sf_dir)


@query(f"WITH {V} " + _NORM.format(g="(1 + (vox // 8) / 10::DOUBLE)", b="(vox // 8 - 4) / 2::DOUBLE"))
def group_norm_affine(spark, sf_dir):
    return _normed(spark, sf_dir, [1 + g / 10 for g in range(8)], [(g - 4) / 2 for g in range(8)])


_UNITS = "SELECT tr, o, sum(v * (((vox * 7 + o * 3) % 11) - 5) / 10::DOUBLE) AS s FROM v, (SELECT unnest(range(0, {n})) AS o) GROUP BY 1, 2"


def _matrix(n: int, voxels: int = 64) -> list[list[float]]:
    return [[((v * 7 + o * 3) % 11 - 5) / 10 for v in range(voxels)] for o in range(n)]


@query(f"WITH {V} SELECT tr, o AS unit, round(s, 5) AS v FROM ({_UNITS.format(n=4)})")
def dense(spark, sf_dir):
    v = packed_volumes(spark, sf_dir).select("tr", F.posexplode(packed.dense(F.col("voxels"), _matrix(4))).alias("unit", "v"))
    return v.select("tr", F.col("unit").cast("long").alias("unit"), F.round("v", 5).alias("v"))


@query(f"""WITH {V}, h AS (SELECT tr, o, s * tanh(ln(1 + exp(s))) AS a FROM ({_UNITS.format(n=6)})),
    p AS (SELECT tr, unit, sum(a * (((o * 7 + unit * 3) % 11) - 5) / 10::DOUBLE) AS s FROM h, (SELECT unnest(range(0, 20)) AS unit) GROUP BY 1, 2),
    k AS (SELECT tr, unit, sum(a * (((o * 7 + (unit + 20) * 3) % 11) - 5) / 10::DOUBLE) AS s FROM h, (SELECT unnest(range(0, 10)) AS unit) GROUP BY 1, 2)
    SELECT x.tr, x.unit // 2 AS sub, round(x.s, 5) AS x, round(y.s, 5) AS y, round(k.s * tanh(ln(1 + exp(k.s))), 5) AS confidence
    FROM p x JOIN p y ON x.tr = y.tr AND y.unit = x.unit + 1 JOIN k ON k.tr = x.tr AND k.unit = x.unit // 2 WHERE x.unit % 2 = 0""")
def ten_heads(spark, sf_dir):
    """A hidden layer with mish, ten position heads and the confidence head, which ends with mish and may be negative."""
    v = packed_volumes(spark, sf_dir).select("tr", packed.activate(packed.dense(F.col("voxels"), _matrix(6))).alias("h"))
    out = _matrix(30, 6)
    v = v.select("tr", packed.dense(F.col("h"), out[:20]).alias("p"), packed.activate(packed.dense(F.col("h"), out[20:])).alias("c"))
    one = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.struct(j.cast("long").alias("sub"), F.get("p", 2 * j).alias("x"), F.get("p",
        2 * j + 1).alias("y"), F.get("c", j).alias("confidence")))
    return v.select("tr", F.explode(one).alias("r")).select("tr", "r.sub", *[F.round(f"r.{c}", 5).alias(c) for c in ("x", "y", "confidence")])


_BLOCK = """n{k} AS (SELECT tr, vox, (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 0.00001::DOUBLE) AS v FROM {of} WINDOW w AS (PARTITION BY tr, vox // 8)),
    m{k} AS (SELECT tr, vox, vox // 16 AS x, (vox // 4) % 4 AS y, vox % 4 AS z, v * tanh(ln(1 + exp(v))) AS v FROM n{k}),
    r{k} AS (SELECT a.tr, a.vox, sum(b.v * {w}) AS v FROM m{k} a JOIN m{k} b ON a.tr = b.tr AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND
    abs(a.z - b.z) <= 1 GROUP BY 1, 2)"""


@query(f"""WITH {V}, {_BLOCK.format(k=0, of="v", w=_W.format(k=0))}, {_BLOCK.format(k=1, of="r0", w=_W.format(k=1))}
    SELECT v.tr, v.vox, round(v.v + r1.v, 5) AS v FROM v JOIN r1 ON v.tr = r1.tr AND v.vox = r1.vox""")
def residual_block(spark, sf_dir):
    layers = network.chain(*[("norm", {"groups": 8}), ("mish", {}), _CONV] * 2)
    unit = {"gamma": np.ones(8), "beta": np.zeros(8)}
    weights = {"norm0": unit, "norm3": unit} | {f"conv{3 * k + 2}": _kernel([[_weight(i, k) for i in range(27)]]) for k in range(2)}
    out = _run(spark, sf_dir, [*layers, network.Layer("sum", "add", (layers[-1].name, "input"))], weights)
    v = out.select("tr", F.posexplode("voxels").alias("vox", "v"))
    return v.select("tr", F.col("vox").cast("long").alias("vox"), F.round("v", 5).alias("v"))


@query(f"""WITH {V} SELECT a.tr, round(a.s, 5) AS p0, round(b.s, 5) AS p1 FROM ({_UNITS.format(n=2)}) a JOIN ({_UNITS.format(n=2)}) b ON a.tr = b.tr WHERE
    a.o = 0 AND b.o = 1""")
def predict_volumes(spark, sf_dir):
    """A predictor run over packed volumes in Arrow batches."""
    out = predict.run(packed_volumes(spark, sf_dir), predict.LinearReadout.fixed(64, 2))
    return out.select("tr", F.round("p0", 5).alias("p0"), F.round("p1", 5).alias("p1"))


_MASK = f"{C}, m AS (SELECT x, y, z FROM c GROUP BY ALL HAVING avg(v) > 0.001)"
_EDGES = """d AS (SELECT DISTINCT x FROM m), g AS (SELECT x, x - lag(x) OVER (ORDER BY x) AS gap, lag(x) OVER (ORDER BY x) AS before FROM d),
    e AS (SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max, min(x) + (max(x) - min(x)) // 2 AS mid,
      (SELECT (before + x) // 2 FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, x LIMIT 1) AS gap_mid FROM m)"""
#: Voxels in one row along x, so that the mask has gaps.
_ROW = f"{V}, m AS (SELECT vox AS x, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS z FROM v GROUP BY ALL HAVING avg(v) > 0.001)"


def _mean_mask(g: DataFrame) -> DataFrame:
    return g.groupBy("x", "y", "z").agg(F.avg("v").alias("v")).where("v > 0.001").select("x", "y", "z")


@query(f"WITH {_ROW}, {_EDGES} SELECT * FROM e")
def mask_edges(spark, sf_dir):
    """Box, midpoint and widest gap of the mask of all voxels, over all TRs, whose mean is positive. One exchange of partial sums."""
    v = packed_volumes(spark, sf_dir).select("tr", F.posexplode("voxels").alias("x", "v"))
    zero = F.lit(0).cast("long")
    return volume.edges(_mean_mask(v.select("tr", F.col("x").cast("long").alias("x"), zero.alias("y"), zero.alias("z"), "v")))


@query(f"""WITH {_MASK}, {_EDGES}, f AS (SELECT c.tr, c.x, c.y, c.z, CASE WHEN m.x IS NULL THEN 0 ELSE v END AS v FROM c LEFT JOIN m ON c.x = m.x AND
c.y = m.y AND c.z = m.z)
    SELECT tr, CASE WHEN x >= coalesce(gap_mid, mid) THEN x - coalesce(gap_mid, mid) ELSE x - x_min + x_max - coalesce(gap_mid, mid) END AS x, y -
    y_min AS y, z - z_min AS z, round(v, 6) AS v
    FROM f, e WHERE x >= x_min AND x < x_max AND y >= y_min AND y < y_max AND z >= z_min AND z < z_max""")
def cut_mask(spark, sf_dir):
    """Both eyes cut from each volume with a mask and its edges. One exchange of partial sums for the mask."""
    g = grid(spark, sf_dir)
    return rounded(volume.cut_eyes(g, _mean_mask(g)).select("tr", "x", "y", "z", "v"))


@query(f"""WITH {C}, u AS (SELECT x, y, z, avg(v) AS v FROM c GROUP BY ALL), k AS (SELECT tr, avg(v) AS m FROM c GROUP BY 1),
    h AS (SELECT min(v) AS lo, (max(v) - min(v)) / 75 AS w FROM c WHERE v > 0)
    SELECT 'slice x' AS part, y AS a, z AS b, round(v, 6) AS v FROM u WHERE x = 1
    UNION ALL SELECT 'slice y', x, z, round(v, 6) FROM u WHERE y = 2 UNION ALL SELECT 'slice z', x, y, round(v, 6) FROM u WHERE z = 3
    UNION ALL SELECT 'mean x', y, z, round(avg(v), 6) FROM c GROUP BY 2, 3 UNION ALL SELECT 'mean y', x, z, round(avg(v), 6) FROM c GROUP BY 2, 3
    UNION ALL SELECT 'mean z', x, y, round(avg(v), 6) FROM c GROUP BY 2, 3
    UNION ALL SELECT 'course', tr, NULL, round((m - (SELECT min(m) FROM k)) / (SELECT max(m) - min(m) FROM k), 6) FROM k
    UNION ALL SELECT 'histogram', least(CAST(floor((v - lo) / w) AS BIGINT), 74), NULL, CAST(count(*) AS DOUBLE) FROM c, h WHERE v > 0 GROUP BY 2""")
def volume_report(spark, sf_dir):
    """The data behind the quality report."""
    return rounded(volume.voxel_report(grid(spark, sf_dir), (1, 2, 3)))


_CENTRES = f"""{C}, r AS (SELECT c.*, v.run FROM c JOIN (SELECT DISTINCT run, tr FROM v) v USING (tr)), w AS (SELECT run, tr, x, y, z, greatest(v, 0) AS w FROM r),
    o AS (SELECT run, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * z) / sum(w) AS cz FROM w GROUP BY 1),
    t AS (SELECT sum(w * x) / sum(w) AS tx, sum(w * y) / sum(w) AS ty, sum(w * z) / sum(w) AS tz FROM w WHERE tr = 7),
    d AS (SELECT run, CAST(round(tx - cx) AS BIGINT) AS dx, CAST(round(ty - cy) AS BIGINT) AS dy, CAST(round(tz - cz) AS BIGINT) AS dz FROM o, t)"""


def _template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_volumes(spark, sf_dir).where("tr = 7")


@query(f"""WITH {_CENTRES}, g AS (SELECT DISTINCT tr, run FROM r), i AS (SELECT tr, run, j // 16 AS x, (j // 4) % 4 AS y, j % 4 AS z FROM g, (SELECT
unnest(range(0, 64)) AS j))
    SELECT i.tr, i.x, i.y, i.z, round(coalesce(r.v, 0), 6) AS v FROM i JOIN d ON d.run = i.run LEFT JOIN r ON r.tr = i.tr AND r.x = i.x - dx AND r.y =
    i.y - dy AND r.z = i.z - dz""")
def register_runs(spark, sf_dir):
    """Each run moved so that its centre of mass falls on that of one volume. One exchange of a row a run and task."""
    v = register.by_centre(packed_volumes(spark, sf_dir), _template(spark, sf_dir), SHAPE)
    return rounded(packed.long_form(v, SHAPE))


@query(f"WITH {_CENTRES}, l AS (SELECT sqrt(dx ** 2 + dy ** 2 + dz ** 2) AS l FROM d) SELECT round(sum(l), 6) AS total, round(avg(l), 6) AS mean, round(stddev_pop(l), 6) AS std, round(median(l), 6) AS median FROM l")
def register_statistics(spark, sf_dir):
    return rounded(register.statistics(register.shifts(packed_volumes(spark, sf_dir), _template(spark, sf_dir), SHAPE)))


def _turn(r: Column | str):
    """(angle about z, scale, step along x, y, z) of run ``r``, by arithmetic."""
    return ((r * 7) % 11 - 5) / 20, 1 + ((r * 3) % 5 - 2) / 20, ((r * 5) % 7 - 3) / 4, ((r * 2) % 5 - 2) / 4, ((r * 4) % 3 - 1) / 4


def _transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, pass, matrix: a similarity about the middle of the grid for each run."""
    a, s, *by = _turn(F.col("run").cast("double"))
    rows = [[s * F.cos(a), -s * F.sin(a), F.lit(0.0)], [s * F.sin(a), s * F.cos(a), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), s]]
    numbers = [c for row, d in zip(rows, by) for c in (*row, d + 1.5 - 1.5 * (row[0] + row[1] + row[2]))]
    runs = packed_volumes(spark, sf_dir).select("run").distinct()
    return runs.select("run", F.lit(0).cast("long").alias("pass"), F.array(*[n.cast("double") for n in numbers]).alias("matrix"))


_TURN = """k AS (SELECT run, ((run * 7) % 11 - 5) / 20::DOUBLE AS a, 1 + ((run * 3) % 5 - 2) / 20::DOUBLE AS s, ((run * 5) % 7 - 3) / 4::DOUBLE AS dx, ((run * 2) % 5 - 2) / 4::DOUBLE AS dy,
      ((run * 4) % 3 - 1) / 4::DOUBLE AS dz FROM (SELECT DISTINCT run FROM v)),
    q AS (SELECT run, s * cos(a) AS c, s * sin(a) AS n, s, dx + 1.5 - 1.5 * (s * cos(a) - s * sin(a)) AS tx, dy + 1.5 - 1.5 * (s * sin(a) + s * cos(a)) AS ty, dz + 1.5 - 1.5 * s AS tz FROM k)"""


@query(f"""WITH {C}, {_TURN}, i AS (SELECT DISTINCT run, tr FROM v), g AS (SELECT run, tr, j // 16 AS x, (j // 4) % 4 AS y, j % 4 AS z FROM i, (SELECT unnest(range(0, 64)) AS j)),
    p AS (SELECT tr, x, y, z, c * x - n * y + tx AS px, n * x + c * y + ty AS py, s * z + tz AS pz FROM g JOIN q USING (run)),
    e AS (SELECT *, unnest(range(0, 8)) AS k FROM p),
    w AS (SELECT tr, x, y, z, CAST(floor(px) AS BIGINT) + k // 4 AS cx, CAST(floor(py) AS BIGINT) + (k // 2) % 2 AS cy, CAST(floor(pz) AS BIGINT) + k % 2 AS cz,
      CASE WHEN k // 4 = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END * CASE WHEN (k // 2) % 2 = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END
      * CASE WHEN k % 2 = 1 THEN pz - floor(pz) ELSE 1 - pz + floor(pz) END AS w FROM e)
    SELECT w.tr, w.x, w.y, w.z, round(coalesce(sum(w.w * c.v), 0), 6) AS v FROM w LEFT JOIN c ON c.tr = w.tr AND c.x = w.cx AND c.y = w.cy AND c.z = w.cz GROUP BY ALL""")
def similarity_resample(spark, sf_dir):
    """Each volume turned, scaled and moved by its run's transform, with trilinear values. Transforms are a row a run."""
    v = register.resample(packed_volumes(spark, sf_dir), _transforms(spark, sf_dir), SHAPE)
    return rounded(packed.long_form(v, SHAPE))


@query(f"""WITH {V}, {_TURN}, u AS (SELECT run, unnest([c, -n, 0, tx, n, c, 0, ty, 0, 0, s, tz]) AS m FROM q)
    SELECT run, CAST(0 AS BIGINT) AS pass, round(sum(m), 6) AS total, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(median(m), 6) AS median FROM u GROUP BY run""")
def transform_statistics(spark, sf_dir):
    return rounded(register.transform_statistics(_transforms(spark, sf_dir)))


@query(None)
def register_similarity(spark, sf_dir):
    """Each run's mean image fitted to one volume by a similarity, in two passes: run, pass, and how well it correlates."""
    template = np.array(_template(spark, sf_dir).select("voxels").first()[0])
    return register.similarity(packed_volumes(spark, sf_dir), template, SHAPE, masks=(None, np.ones(64, bool))).select("run", "pass", F.round("correlation", 4).alias("correlation"))


@query(f"WITH {C} SELECT tr, x, y, z, round(v, 6) AS v FROM c")
def packed_again(spark, sf_dir):
    """Volumes put into long form, packed by one exchange and put into long form again."""
    return rounded(packed.long_form(packed.pack(grid(spark, sf_dir), SHAPE), SHAPE))
