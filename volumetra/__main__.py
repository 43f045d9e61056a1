"""Fit a model on the training participants and score it on the others: ``python -m volumetra FOLDER [--model network --way leave_one_out ...]``.

FOLDER holds ``volumes`` (participant, tr, voxels, and for networks dims; dataset if there are several) and ``labels`` (participant, tr, sub, x, y) as Parquet. For each round of the split the scorecard is
written to ``scores/<round>``, predictions to ``evaluation/<round>``, weights to ``weights/<round>``; a network's training states are in ``training/<round>``, from which a run that was stopped goes on.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.operators import network, predict, splits, training
from volumetra.options import Options


def targets(labels: DataFrame, subs: int) -> DataFrame:
    """participant, tr, target: x and y of each of the ``subs`` samples in turn; other TRs go."""
    packed = labels.groupBy("participant", "tr").agg(F.array_sort(F.collect_list(F.struct("sub", "x", "y"))).alias("s"))  # a TR has about ten samples
    return packed.select("participant", "tr", F.flatten(F.transform("s", lambda v: F.array(v["x"], v["y"]))).alias("target")).where(F.size("target") == 2 * subs)


def rounds(volumes: DataFrame, options: Options) -> tuple[DataFrame, list[str]]:
    """(round, participant, part) and the names of the rounds: one for a holdout split, one a dataset for leave-one-out."""
    units = volumes.select("participant", "dataset" if "dataset" in volumes.columns else F.lit(0).alias("dataset")).distinct()
    parts = splits.split(units, options.way, "participant", "dataset", options.share)
    return parts, sorted(r[0] for r in parts.select("round").distinct().collect())


def fitted(train: DataFrame, options: Options, shape: tuple[int, int, int] | None, folder: str) -> predict.Predictor:
    """A model of x and y of each sample and then of each one's error, which a readout takes for 0 and a network learns."""
    k = options.subsamples
    if options.model == "network":
        net = network.Network.fresh(options.layers(), shape, options.seed)
        keyed = train.withColumn("key", F.pmod(F.xxhash64("participant", "tr"), F.lit(1 << 40)))
        dealt = training.deal(keyed.select("key", "voxels", "target"), options.steps, folder, "key")
        return training.train(dealt, net, options.recipe(), folder, key="key")[0]
    n = train.select(F.size("voxels")).first()[0]
    model = predict.fit(train, n, 2 * k, options.ridge)
    return predict.LinearReadout(np.hstack([model.weights, np.zeros((n, k))]), np.concatenate([model.bias, np.zeros(k)]))


def train_and_score(spark: SparkSession, volumes: DataFrame, labels: DataFrame, options: Options, round_: str = "0", parts: DataFrame | None = None, folder: str = "") -> tuple[predict.Predictor, DataFrame, DataFrame]:
    """(model, predictions beside the truth, scorecard) of the test participants of one round."""
    parts = rounds(volumes, options)[0] if parts is None else parts
    train, test = splits.sides(volumes, parts, round_, "participant")
    shape = tuple(volumes.select("dims").first()[0]) if options.model == "network" else None
    model = fitted(train.join(targets(labels, options.subsamples), ["participant", "tr"]), options, shape, f"{folder}/training/{round_}")
    return model, *predict.evaluate(test, labels, model, options.subsamples, options.percent)


def main(args: list[str]) -> None:
    folder, options = args[0], Options.from_args(args[1:])
    spark = SparkSession.builder.appName("volumetra").getOrCreate()
    volumes, labels = spark.read.parquet(f"{folder}/volumes"), spark.read.parquet(f"{folder}/labels")
    parts, names = rounds(volumes, options)
    for name in names:
        model, both, scores = train_and_score(spark, volumes, labels, options, name, parts, folder)
        if isinstance(model, network.Network):
            model.tables(spark)[1].write.mode("overwrite").parquet(f"{folder}/weights/{name}")
        else:
            model.save(spark, f"{folder}/weights/{name}")
        predict.write_evaluation(both, f"{folder}/evaluation/{name}")
        scores.write.parquet(f"{folder}/scores/{name}")


if __name__ == "__main__":
    main(sys.argv[1:])
