"""Training a network step by step, with weights, optimiser state and losses as one table.

A step is one job. Every task runs its share of the batch through the network and back and adds up what it finds, so it sends one sum for each weight, whatever its number
of rows. These sums meet the state chunk by chunk: one exchange by layer, part and chunk, in which the chunk's new weights are made, so neither the driver nor any one task gets
all gradients. The new state is written before the next step reads it; a run that was stopped goes on from the last state that is whole.

The loss of a sample is its distance to the truth plus ``share`` times the squared difference between that distance and the confidence, which so learns to
tell the error. Weights move by Adam. Augmentation and dropout are drawn from key and step, so a task that runs again gets the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.operators import batches, network, splits

SUMS = "layer string, part string, chunk int, `values` array<double>, n long"
STATE = "layer string, part string, dims array<int>, chunk int, `values` array<double>, m array<double>, v array<double>"
LOSS = "loss"


@dataclass(frozen=True)
class Recipe:
    """How a network is trained. ``rotation`` (degrees), ``shift`` (voxels), ``zoom`` (per cent): bounds of the augmentation."""

    rate: float = 0.00002
    epochs: int = 25
    steps: int = 1500
    share: float = 0.1
    decay: float = 0.9
    seed: int = 0
    rotation: int = 0
    shift: int = 0
    zoom: int = 0

    def rate_at(self, step: int) -> float:
        """Falls from epoch to epoch to 0 after the last."""
        return self.rate * (1 - step // self.steps / self.epochs) ** self.decay


def loss(out: np.ndarray, target: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance and confidence loss of each row, derivative of each row's loss): outputs are x and y of each sample in turn, then the confidences."""
    subs = target.shape[1] // 2
    off = (out[:, : 2 * subs] - target).reshape(len(out), subs, 2)
    far = np.sqrt((off * off).sum(axis=2))
    miss = far - out[:, 2 * subs :]
    d_far = (1 + 2 * share * miss) / subs
    d_xy = np.divide(d_far, far, out=np.zeros_like(far), where=far > 0)[:, :, None] * off
    return far.mean(axis=1), (miss * miss).mean(axis=1), np.hstack([d_xy.reshape(len(out), -1), -2 * share * miss / subs])


def _add(total: dict, parts: dict) -> None:
    for layer, own in parts.items():
        for part, g in own.items():
            mine = total.setdefault(layer, {})
            mine[part] = mine[part] + g if part in mine else g.astype(float)


def gradients(rows: DataFrame, net: network.Network, recipe: Recipe, step: int, key: str = "tr") -> DataFrame:
    """(layer, part, chunk, values, n): each task's sums over its ``n`` rows (key, voxels, target); the losses are a layer without a name. Rows without a whole target are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(net)
    wide = max([1, *[int(x.params.get("filters", 1)) for x in net.layers]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, sums, n = sent.value, {}, np.zeros(2), 0
        for part, x in batches.blocks(parts, "voxels", 64 * wide * len(own.layers)):
            keys, target = part.column(key).to_numpy(), batches.block(part.column("target"))
            good = np.isfinite(target).all(axis=1)
            if not good.any():
                continue
            keys, target, x = keys[good], target[good], np.nan_to_num(x[good])
            if recipe.rotation or recipe.shift or recipe.zoom:
                x = batches.turned(x, own.shape, keys + 1_000_003 * step, recipe.rotation, recipe.shift, recipe.zoom)
            out, backs = own.forward(x, [np.random.default_rng([recipe.seed, step, int(k) % (1 << 63)]) for k in keys])
            far, miss, d = loss(out.astype(float), target, recipe.share)
            _add(total, own.backward(d, backs))
            sums += far.sum(), miss.sum()
            n += len(far)
        if n:
            total[""] = {LOSS: sums}
            for layer, part, _, chunk, values in network.chunked(total):
                yield pa.RecordBatch.from_arrays([pa.array([layer]), pa.array([part]), pa.array([chunk], pa.int32()), batches.arrays(values[None, :]), pa.array([n])], names=["layer", "part", "chunk", "values", "n"])

    return rows.where("target IS NOT NULL").select(key, "voxels", "target").mapInArrow(run, SUMS)


def started(spark: SparkSession, net: network.Network) -> DataFrame:
    """The state before the first step."""
    _, weights = net.tables(spark)
    zeros = F.transform("values", lambda v: F.lit(0.0))
    return weights.withColumns({"m": zeros, "v": zeros})


def updated(state: DataFrame, sums: DataFrame, step: int, rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-7) -> DataFrame:
    """The state after step number ``step`` (from 0): each chunk with the sums that reached it. A step without rows changes nothing; its losses are a row of their own, (distance, confidence, rows)."""
    pace = rate * np.sqrt(1 - b2 ** (step + 1)) / (1 - b1 ** (step + 1))
    names = [f.split()[0].strip("`") for f in STATE.split(", ")]

    def one(t: pa.Table) -> pa.Table:
        sums_ = t.filter(pa.array(t["n"].is_valid())).to_pylist() if t["n"].null_count < len(t) else []
        n = sum(r["n"] for r in sums_)
        g = sum(np.array(r["values"]) for r in sums_) / max(n, 1)
        if t["layer"][0].as_py() == "" and n:
            row = {"layer": "", "part": LOSS, "dims": [3], "chunk": step, "values": [*g.tolist(), float(n)], "m": [], "v": []}
        else:
            row = next(r for r in t.to_pylist() if r["n"] is None)
            if n:
                w, m, v = (np.array(row[c]) for c in ("values", "m", "v"))
                m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
                row |= {"values": w - pace * m / (np.sqrt(v) + eps), "m": m, "v": v}
        return pa.Table.from_pylist([{k: row[k] for k in names}], schema=pa.schema([("layer", pa.string()), ("part", pa.string()), ("dims", pa.list_(pa.int32())), ("chunk", pa.int32())]
            + [(c, pa.list_(pa.float64())) for c in ("values", "m", "v")]))

    none = F.lit(None)
    both = state.withColumn("n", none.cast("long")).unionByName(sums.withColumns({"dims": none.cast("array<int>"), "m": none.cast("array<double>"), "v": none.cast("array<double>"),
        "chunk": F.when(F.col("layer") == "", F.lit(step)).otherwise(F.col("chunk")).cast("int")}).select(*names, "n"))
    return both.groupBy("layer", "part", "chunk").applyInArrow(one, STATE)


def current(state: DataFrame, net: network.Network) -> network.Network:
    """``net`` with the weights of ``state``."""
    return network.Network(net.layers, network.gathered(state.where("layer <> ''")), net.shape, net.kind)


def losses(state: DataFrame) -> DataFrame:
    """step, distance, confidence, n of all steps so far."""
    v = lambda i: F.get("values", F.lit(i))
    return state.where("layer = ''").select(F.col("chunk").cast("long").alias("step"), v(0).alias("distance"), v(1).alias("confidence"), v(2).cast("long").alias("n"))


def deal(samples: DataFrame, steps: int, folder: str, key: str = "tr") -> DataFrame:
    """``samples`` with ``step``, by a hash of their key, written in ranges of it, so that a step reads its own rows and no others."""
    dealt = samples.withColumn("step", F.expr(f"pmod({splits.mixed_hash(key)}, {steps})"))
    dealt.repartitionByRange("step").sortWithinPartitions("step").write.mode("overwrite").parquet(f"{folder}/samples")
    return samples.sparkSession.read.parquet(f"{folder}/samples")


def _done(spark: SparkSession, folder: str) -> list[int]:
    """The steps whose state is whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().removeprefix("state-")) for f in found or [])


def resumed(spark: SparkSession, folder: str) -> tuple[int, DataFrame] | None:
    """(steps done, state) of the last whole state in ``folder``."""
    done = _done(spark, folder)
    return (done[-1], spark.read.schema(STATE).parquet(f"{folder}/state-{done[-1]}")) if done else None


def train(samples: DataFrame, net: network.Network, recipe: Recipe, folder: str, until: int | None = None, key: str = "tr", keep: int = 2) -> tuple[network.Network, DataFrame]:
    """(trained network, losses by step) from samples (key, step, voxels, target); rows of step s mod ``recipe.steps`` are the batch of step s.

    States are written to ``folder``, of which the last ``keep`` stay; what is found there is gone on from. ``until``: stop after so many steps in all.
    """
    spark = samples.sparkSession
    before = resumed(spark, folder)
    if before is None:
        started(spark, net).write.mode("overwrite").parquet(f"{folder}/state-0")
        before = resumed(spark, folder)
    step, state = before
    while step < (recipe.epochs * recipe.steps if until is None else until):
        net = current(state, net)
        rows = samples.where(F.col("step") == step % recipe.steps)
        new = updated(state, gradients(rows, net, recipe, step, key), step, recipe.rate_at(step))
        step += 1
        new.write.mode("overwrite").parquet(f"{folder}/state-{step}")
        state = spark.read.schema(STATE).parquet(f"{folder}/state-{step}")
        for old in _done(spark, folder)[:-keep]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state-{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return current(state, net), losses(state)
