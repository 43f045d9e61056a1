"""Running and fitting predictors over packed volumes; any object with ``outputs`` and ``predict`` will do."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.operators import batches, metrics


class Predictor(Protocol):
    outputs: int

    def predict(self, volumes: np.ndarray) -> np.ndarray: ...


class LinearReadout:
    """One weighted sum of the voxels an output, a stand-in where no deep model is given; its weights may be fitted, saved and loaded."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray | None = None):
        self.weights = np.asarray(weights, float)
        self.outputs = self.weights.shape[1]
        self.bias = np.zeros(self.outputs) if bias is None else np.asarray(bias, float)

    @classmethod
    def fixed(cls, voxels: int, outputs: int) -> LinearReadout:
        """Weights from -0.5 to 0.5 by arithmetic that any engine can replay."""
        v, o = np.arange(voxels)[:, None], np.arange(outputs)[None, :]
        return cls((((v * 7 + o * 3) % 11) - 5) / 10)

    def predict(self, volumes: np.ndarray) -> np.ndarray:
        return volumes @ self.weights + self.bias

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps({"weights": self.weights.tolist(), "bias": self.bias.tolist()}),)],
            "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearReadout:
        return cls(**{k: np.array(v) for k, v in json.loads(spark.read.text(path).first()[0]).items()})


def run(volumes: DataFrame, model: Predictor, batch: int = 1024, keys: tuple[str, ...] = ("tr",)) -> DataFrame:
    """(keys, voxels) -> (keys, p0, p1, ...). Missing voxels count as 0."""
    sent = volumes.sparkSession.sparkContext.broadcast(model)  # a model's size, whatever the number of volumes

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for i in range(0, len(p), batch):
                part = p.iloc[i : i + batch]
                out = sent.value.predict(np.nan_to_num(np.stack(part["voxels"].to_numpy()).astype(float)))
                yield pd.DataFrame({**{k: part[k].to_numpy() for k in keys}, **{f"p{k}": out[:, k] for k in range(sent.value.outputs)}})

    kinds = {f.name: f.dataType.simpleString() for f in volumes.schema}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"p{k} double" for k in range(model.outputs)])
    return volumes.select(*keys, "voxels").mapInPandas(predict, schema)


#: Numbers of a matrix that each task may send: with more voxels the fit goes by steps.
MOST_PRODUCTS = 1 << 22


def _added(rows: DataFrame, product, width: int) -> np.ndarray:
    """The sum over all rows of ``product(voxels with a constant, targets)``, an array with rows of ``width``: a task adds up its rows, and one exchange by row of the array adds up the tasks."""

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part, x in batches.blocks(parts, "voxels"):
            y = batches.block(part.column("target"))
            good = np.isfinite(y).all(axis=1)
            x = np.hstack([np.nan_to_num(x[good]), np.ones((int(good.sum()), 1))])
            own = product(x, y[good])
            total = own if total is None else total + own
        if total is not None:
            for i in range(0, len(total), 256):
                at = np.arange(i, min(i + 256, len(total)), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), batches.arrays(total[at])], names=["at", "s"])

    def one(t: pa.Table) -> pa.Table:
        s = sum(np.array(v.values) for v in t["s"])
        return pa.table({"at": t["at"][:1], "s": batches.arrays(s[None, :])})

    made = rows.where("target IS NOT NULL").mapInArrow(sums, "at long, s array<double>").groupBy("at").applyInArrow(one, "at long, s array<double>").toPandas().sort_values("at")
    return np.stack(made["s"].to_numpy()).reshape(-1, width) if len(made) else np.zeros((0, width))


def fit(rows: DataFrame, voxels: int, outputs: int, ridge: float = 1.0, steps: int = 60, close: float = 1e-8) -> LinearReadout:
    """Ridge regression of ``target`` (array) on ``voxels`` (array). Rows with a missing target are left out.

    With few voxels each task sends its sums of products and the equations are solved here. With more, the same equations are solved by conjugate gradients, in which a task only sends
    sums of the model's own size, step after step; ``close``: the residual, as a share of the first, at which they end.
    """
    d, rows = voxels + 1, rows.select("voxels", "target")
    pull = np.full((d, 1), ridge)
    pull[-1] = 1e-9  # the constant is free
    if d * (d + outputs) <= MOST_PRODUCTS:
        total = _added(rows, lambda x, y: x.T @ np.hstack([x, y]), d + outputs)
        if not len(total):
            return LinearReadout(np.zeros((voxels, outputs)), np.zeros(outputs))
        w = np.linalg.solve(total[:, :d] + np.diag(pull.ravel()), total[:, d:])
        return LinearReadout(w[:-1], w[-1])
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    sc = rows.sparkSession.sparkContext
    try:
        left = _added(rows, lambda x, y: x.T @ y, outputs)
        w = np.zeros((d, outputs))
        if not len(left):
            return LinearReadout(w[:-1], w[-1])
        way, size = left.copy(), (left * left).sum(axis=0)
        first = size.copy()
        for _ in range(steps):
            if (size <= close**2 * first).all():
                break
            sent = sc.broadcast(way)  # the size of the model
            bent = _added(rows, lambda x, y: x.T @ (x @ sent.value), outputs) + pull * way
            far = np.divide(size, (way * bent).sum(axis=0), out=np.zeros_like(size), where=size > 0)
            w, left = w + far * way, left - far * bent
            new = (left * left).sum(axis=0)
            way, size = left + np.divide(new, size, out=np.zeros_like(new), where=size > 0) * way, new
            sent.unpersist()
    finally:
        rows.unpersist()
    return LinearReadout(w[:-1], w[-1])


def samples(predicted: DataFrame, keys: tuple[str, ...], subs: int) -> DataFrame:
    """(keys, sub, px, py, unc) from outputs p0 ... : x and y of each sub-sample in turn, then each one's uncertainty, of which the absolute value counts."""
    one = lambda j: F.struct(F.lit(j).cast("long").alias("sub"), F.col(f"p{2 * j}").alias("px"), F.col(f"p{2 * j + 1}").alias("py"),
        F.abs(F.col(f"p{2 * subs + j}")).alias("unc"))
    return predicted.select(*keys, F.explode(F.array(*[one(j) for j in range(subs)])).alias("s")).select(*keys, "s.*")


def evaluate(volumes: DataFrame, truth: DataFrame, model: Predictor, subs: int = 10, percent: float = 80) -> tuple[DataFrame, DataFrame]:
    """(predictions beside the truth, scorecard) of all participants in one job.

    ``volumes``: participant, tr, voxels; ``truth``: participant, tr, sub, x, y. The model is run once a volume; samples without a counterpart go.
    """
    p = samples(run(volumes, model, keys=("participant", "tr")), ("participant", "tr"), subs)
    both = p.join(truth.select("participant", "tr", "sub", F.col("x").alias("tx"), F.col("y").alias("ty")), ["participant", "tr", "sub"])
    return both, metrics.scorecard(both, percent)


def write_evaluation(both: DataFrame, path: str) -> None:
    """Truth and predictions as Parquet, by participant."""
    both.repartition("participant").write.partitionBy("participant").parquet(path)
