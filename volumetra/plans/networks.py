"""Queries that run and train networks over packed volumes, with weights by arithmetic that any engine can replay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.operators import network, training
from volumetra.plans.registry import V, query
from volumetra.sources.tables import packed_volumes

SHAPE = (4, 4, 4)


def _w(i, out, salt: int):
    """The weight from input number ``i`` to output ``out``."""
    return ((i * 7 + out * 3 + salt) % 11 - 5) / 20


def _dense(n: int, m: int, salt: int) -> dict:
    return {"kernel": _w(np.arange(n)[:, None], np.arange(m)[None, :], salt), "bias": np.arange(m) / 10}


def _conv(cin: int, cout: int, salt: int) -> dict:
    i = np.arange(27 * cin).reshape(3, 3, 3, cin)[..., None]  # offset by offset, channels within
    return {"kernel": _w(i, np.arange(cout), salt), "bias": np.arange(cout) / 10}


LAYERS = network.chain(("conv", {"kernel": 3, "filters": 2}), ("mish", {}), ("norm", {"groups": 2}), ("mish", {}), ("conv", {"kernel": 3, "filters": 2}), ("pool", {"by": 2}),
    ("flatten", {}), ("dense", {"units": 3}), ("mish", {}), ("dense", {"units": 4}))
WEIGHTS = {"conv0": _conv(1, 2, 1), "norm2": {"gamma": np.array([1.2, 0.8]), "beta": np.array([0.1, -0.2])}, "conv4": _conv(2, 2, 2), "dense7": _dense(16, 3, 3), "dense9": _dense(3, 4, 4)}

_SQLW = "((({i}) * 7 + ({o}) * 3 + {salt}) % 11 - 5) / 20::DOUBLE"
_MISH = "{v} * tanh(ln(1 + exp({v})))"
_OFFSET = "((b.x - a.x + 1) * 9 + (b.y - a.y + 1) * 3 + b.z - a.z + 1)"
_NEAR = "a.tr = b.tr AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1"


@query(f"""WITH {V}, c AS (SELECT tr, vox // 16 AS x, (vox // 4) % 4 AS y, vox % 4 AS z, v FROM v), two AS (SELECT unnest(range(0, 2)) AS o),
    c1 AS (SELECT a.tr, a.x, a.y, a.z, o, min(o) / 10::DOUBLE + sum(b.v * {_SQLW.format(i=_OFFSET, o="o", salt=1)}) AS v FROM c a JOIN c b ON {_NEAR}, two GROUP BY ALL),
    m1 AS (SELECT tr, x, y, z, o, ((x * 4 + y) * 4 + z) * 2 + o AS e, {_MISH.format(v="v")} AS v FROM c1),
    n1 AS (SELECT tr, x, y, z, o, CASE WHEN e < 64 THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END * (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 0.00001::DOUBLE)
      + CASE WHEN e < 64 THEN 0.1::DOUBLE ELSE -0.2::DOUBLE END AS v FROM m1 WINDOW w AS (PARTITION BY tr, e // 64)),
    m2 AS (SELECT tr, x, y, z, o, {_MISH.format(v="v")} AS v FROM n1),
    c2 AS (SELECT a.tr, a.x, a.y, a.z, two.o, min(two.o) / 10::DOUBLE + sum(b.v * {_SQLW.format(i=f"{_OFFSET} * 2 + b.o", o="two.o", salt=2)}) AS v
      FROM (SELECT DISTINCT tr, x, y, z FROM m2) a JOIN m2 b ON {_NEAR}, two GROUP BY ALL),
    p AS (SELECT tr, ((x // 2 * 2 + y // 2) * 2 + z // 2) * 2 + o AS i, avg(v) AS v FROM c2 GROUP BY ALL),
    d1 AS (SELECT tr, o, min(o) / 10::DOUBLE + sum(v * {_SQLW.format(i="i", o="o", salt=3)}) AS v FROM p, (SELECT unnest(range(0, 3)) AS o) GROUP BY ALL),
    m3 AS (SELECT tr, o AS i, {_MISH.format(v="v")} AS v FROM d1),
    d2 AS (SELECT tr, o, min(o) / 10::DOUBLE + sum(v * {_SQLW.format(i="i", o="o", salt=4)}) AS v FROM m3, (SELECT unnest(range(0, 4)) AS o) GROUP BY ALL)
    SELECT tr, o AS unit, round(v, 5) AS v FROM d2""")
def model_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two convolutions with channels, a norm, pooling and two dense layers, from tables of layers and weights."""
    layers, weights = network.Network(LAYERS, WEIGHTS, SHAPE, np.float64).tables(spark)
    out = network.run(packed_volumes(spark, sf_dir), network.Network.from_tables(layers, weights, SHAPE, np.float64)).select("tr", F.posexplode("voxels").alias("unit", "v"))
    return out.select("tr", F.col("unit").cast("long").alias("unit"), F.round("v", 5).alias("v"))


SUBS, RATE, SHARE = 2, 0.01, 0.1
#: Two positions from the voxels, and a confidence for each.
READOUT = [*network.chain(("flatten", {})), network.Layer("position", "dense", ("flatten0",), {"units": 2 * SUBS}), *network.chain(("dense", {"units": SUBS}), ("mish", {}), start="flatten0", prefix="confidence."),
    network.Layer("output", "join", ("position", "confidence.mish1"))]
READOUT_WEIGHTS = {"position": _dense(64, 2 * SUBS, 5), "confidence.dense0": _dense(64, SUBS, 6)}


def truth(key, i):
    """The made-up truth of output ``i``: any engine can replay it."""
    return ((key * 31 + i * 17) % 19 - 9) / 2


def _adam(k: int) -> str:
    """The relations of step k (from 0) in SQL: outputs, losses, gradients and new weights."""
    pace = RATE * np.sqrt(1 - 0.999 ** (k + 1)) / (1 - 0.9 ** (k + 1))
    return f"""x{k} AS (SELECT tr, vox, v FROM u WHERE ((tr * 7919 + 13) % 100003) % 2 = {k}),
    z{k} AS (SELECT tr, o, sum(v * w) AS z FROM x{k} JOIN w{k} USING (vox) GROUP BY ALL),
    e{k} AS (SELECT p.tr, p.o // 2 AS s, p.z - ((p.tr * 31 + p.o * 17) % 19 - 9) / 2::DOUBLE AS dx, q.z - ((q.tr * 31 + q.o * 17) % 19 - 9) / 2::DOUBLE AS dy, c.z AS c, {_MISH.format(v="c.z")} AS conf
      FROM z{k} p JOIN z{k} q ON q.tr = p.tr AND q.o = p.o + 1 JOIN z{k} c ON c.tr = p.tr AND c.o = 4 + p.o // 2 WHERE p.o IN (0, 2)),
    f{k} AS (SELECT *, sqrt(dx * dx + dy * dy) AS far, tanh(ln(1 + exp(c))) AS bend FROM e{k}),
    d{k} AS (SELECT tr, unnest([2 * s, 2 * s + 1, 4 + s]) AS o, unnest([(1 + 0.2::DOUBLE * (far - conf)) / 2 * dx / far, (1 + 0.2::DOUBLE * (far - conf)) / 2 * dy / far,
      -0.1::DOUBLE * (far - conf) * (bend + c * (1 - bend * bend) / (1 + exp(-c)))]) AS d FROM f{k}),
    g{k} AS (SELECT vox, o, avg(v * d) AS g FROM x{k} JOIN d{k} USING (tr) GROUP BY ALL),
    s{k} AS (SELECT vox, o, w, 0.9::DOUBLE * m + 0.1::DOUBLE * g AS m, 0.999::DOUBLE * a + 0.001::DOUBLE * g * g AS a FROM w{k} JOIN g{k} USING (vox, o)),
    w{k + 1} AS (SELECT vox, o, w - {float(pace)!r}::DOUBLE * m / (sqrt(a) + 0.0000001::DOUBLE) AS w, m, a FROM s{k})"""


@query(f"""WITH {V}, u AS (SELECT tr, vox, v FROM v UNION ALL SELECT DISTINCT tr, -1, 1::DOUBLE FROM v),
    w0 AS (SELECT vox, o, CASE WHEN vox < 0 THEN (o % 4) / 10::DOUBLE WHEN o < 4 THEN {_SQLW.format(i="vox", o="o", salt=5)} ELSE {_SQLW.format(i="vox", o="o - 4", salt=6)} END AS w,
      0::DOUBLE AS m, 0::DOUBLE AS a FROM (SELECT unnest(range(-1, 64)) AS vox), (SELECT unnest(range(0, 6)) AS o)),
    {_adam(0)}, {_adam(1)}
    SELECT CASE WHEN o < 4 THEN 'position' ELSE 'confidence.dense0' END AS layer, CASE WHEN vox < 0 THEN 'bias' ELSE 'kernel' END AS part,
      CAST(CASE WHEN vox < 0 THEN o % 4 WHEN o < 4 THEN vox * 4 + o ELSE vox * 2 + o - 4 END AS BIGINT) AS i, round(w, 5) AS w FROM w2""")
def train_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of a readout with confidences after two steps of training by Adam. One exchange a step, by chunks of weights."""
    v = packed_volumes(spark, sf_dir)
    target = F.array(*[truth(F.col("tr"), i) for i in range(2 * SUBS)])
    samples = v.select("tr", "voxels", target.alias("target"), F.expr("((tr * 7919 + 13) % 100003) % 2").alias("step"))
    net = network.Network(READOUT, READOUT_WEIGHTS, SHAPE, np.float64)
    recipe = training.Recipe(rate=RATE, epochs=1, steps=2, share=SHARE)
    state = training.started(spark, net)
    for step in range(2):
        net = training.current(state, net)
        state = training.updated(state, training.gradients(samples.where(F.col("step") == step), net, recipe, step), step, RATE)
    flat = state.where("layer <> ''").select("layer", "part", "chunk", F.posexplode("values").alias("i", "w"))
    return flat.select("layer", "part", (F.col("chunk").cast("long") * network.CHUNK + F.col("i")).alias("i"), F.round("w", 5).alias("w"))
