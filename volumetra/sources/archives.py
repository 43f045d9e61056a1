"""Participant archives: NPZ files with one group of members per TR, label tables in CSV, and their tables in Parquet.

An archive names its members ``data_<tr>``, ``label_<tr>`` and, if it has them, ``identifier_<tr>``; a TR counts as present if it has data and labels.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, tr long, identifier string, voxels array<float>, labels array<array<float>>"
_MEMBER = re.compile(r"(data|label|identifier)_([0-9]+)")


def _text(value: np.ndarray | None) -> str | None:
    return None if value is None else "_".join(str(x) for x in np.ravel(value))


def scan_npz(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """One row per archive and TR, ``first`` and ``last`` included; the members of other TRs are not decoded. Pickled members are refused.

    A missing identifier is null; labels keep NaN as null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    members: dict[int, set] = {}
                    for m in filter(None, map(_MEMBER.fullmatch, archive.files)):
                        members.setdefault(int(m[2]), set()).add(m[1])
                    for tr in sorted(t for t, kinds in members.items() if {"data", "label"} <= kinds and (first is None or t >= first) and (last is None or t <= last)):
                        labels = np.atleast_2d(archive[f"label_{tr}"]).astype(np.float32)
                        identifier = _text(archive[f"identifier_{tr}"]) if "identifier" in members[tr] else None
                        yield pd.DataFrame({"path": [name], "tr": [tr], "identifier": [identifier],
                            "voxels": [archive[f"data_{tr}"].astype(np.float32).ravel()], "labels": [list(labels)]})

    missing = lambda v: F.when(F.isnan(v), None).otherwise(v)
    out = files.mapInPandas(decode, SCHEMA)
    return out.withColumns({"voxels": F.transform("voxels", missing), "labels": F.transform("labels", lambda row: F.transform(row, missing))})


def label_samples(archive: DataFrame) -> DataFrame:
    """path, tr, sub, x, y: the samples of scanned archives in long form."""
    s = archive.select("path", "tr", F.posexplode("labels").alias("sub", "xy"))
    return s.select("path", "tr", F.col("sub").cast("long").alias("sub"), F.get("xy", F.lit(0)).cast("double").alias("x"), F.get("xy",
        F.lit(1)).cast("double").alias("y"))


def scan_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """path, i, px, py of label tables with a header and two columns of numbers; what is no number is null.

    Rows are numbered from 0 in the order of each file, which is read as one row: such tables hold one line per stimulus.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("i", "line")).where("i > 0 and trim(line) <> ''")
    cell = lambda k: F.expr(f"try_cast(trim(split(line, ',')[{k}]) as double)")
    return lines.select("path", (F.col("i") - 1).cast("long").alias("i"), cell(0).alias("px"), cell(1).alias("py"))


def write_participants(volumes: DataFrame, labels: DataFrame, path: str, center: bool = False) -> None:
    """Join volumes (dataset, participant, run, tr, voxels) to labels (dataset, participant, run, tr, sub, x, y) and write them by dataset.

    TRs without a counterpart on the other side go. ``center`` takes each participant's median label off. Files are dealt by
    participant and run, so no participant is bound to one task.
    """
    key = ["dataset", "participant", "run", "tr"]
    if center:
        middle = labels.groupBy("dataset", "participant").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
        labels = labels.join(middle, ["dataset", "participant"]).withColumns({"x": F.col("x") - F.col("mx"), "y": F.col("y") - F.col("my")})
    packed = labels.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("sub", "x", "y"))).alias("labels"))  # a TR has about ten samples
    volumes.join(packed, key).repartition("dataset", "participant", "run").write.partitionBy("dataset").parquet(path)


def read_participants(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The written rows; bounds of ``tr``, both included, reach the scan."""
    out = spark.read.parquet(path)
    out = out if first is None else out.where(F.col("tr") >= first)
    return out if last is None else out.where(F.col("tr") <= last)
