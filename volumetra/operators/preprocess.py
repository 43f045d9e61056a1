"""From scanned images to participant tables: registration, cutting with the mask, normalisation and packing, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np

from volumetra.operators import batches, packed, register, volume


def places(mask: DataFrame, shape: packed.Shape) -> tuple[np.ndarray, packed.Shape]:
    """(the number of the image's voxel for each voxel of the eyes, -1 outside the mask; shape of the eyes), as ``volume.cut_eyes`` puts them together. A mask has the size of one image."""
    e = volume.edges(mask).first()  # one row: the box of the mask
    part = e["mid"] if e["gap_mid"] is None else e["gap_mid"]
    inside = np.zeros(shape, bool)
    inside[tuple(mask.select("x", "y", "z").toPandas().to_numpy().T)] = True
    box = (e["x_max"] - e["x_min"], e["y_max"] - e["y_min"], e["z_max"] - e["z_min"])
    at = batches.cells(box) + np.array([0, e["y_min"], e["z_min"]])
    right = at[:, 0] < e["x_max"] - part
    at[:, 0] = np.where(right, at[:, 0] + part, at[:, 0] - (e["x_max"] - part) + e["x_min"])
    return np.where(inside[tuple(at.T)], np.ravel_multi_index(tuple(at.T), shape), -1), box


def eyes(scanned: DataFrame, template: DataFrame, mask: DataFrame, shape: packed.Shape, robust: bool = False, masks: list | None = None) -> tuple[DataFrame, packed.Shape]:
    """(path, tr, voxels of the eyes) of images (path, tr, voxels) of one shape, and the shape of the eyes.

    Images are moved onto the template (one row with voxels), by their centre of mass or, if ``masks`` names the masks of its passes (None: everywhere), by a similarity; the packed images are cut with
    the mask (x, y, z) and its edges, and only the eyes are normalised over time and space.
    """
    images = scanned.select("path", "tr", F.col("voxels").cast("array<double>").alias("voxels"))
    if masks is None:
        moved = register.by_centre(images, template, shape, ("path",))
    else:
        moved, _ = register.by_similarity(images, np.array(template.select("voxels").first()[0]), shape, ("path",), masks)
    own, box = places(mask, shape)
    cut = batches.cut(moved, shape, own, ("path", "tr"))
    normal = volume.normalize(cut.select(F.col("path").alias("run"), "tr", F.posexplode("voxels").alias("vox", "v")), robust)
    at = packed.place(F.col("vox"), box)
    grid = normal.select(F.col("run").alias("path"), "tr", *[p.alias(c) for c, p in zip("xyz", at)], "v")
    return packed.pack(grid, box, ("path", "tr")), box


def participants(eyes_: DataFrame, dataset: str) -> DataFrame:
    """dataset, participant, run, tr, voxels: the participant is the folder of an image, its runs are numbered in the order of their names."""
    folder = F.element_at(F.split("path", "/"), -2)
    runs = eyes_.select("path").distinct().groupBy(folder.alias("participant")).agg(F.array_sort(F.collect_list("path")).alias("paths"))  # the runs of one participant
    numbered = runs.select("participant", F.posexplode("paths").alias("run", "path"))
    return eyes_.join(numbered, "path").select(F.lit(dataset).alias("dataset"), "participant", "run", "tr", "voxels")
