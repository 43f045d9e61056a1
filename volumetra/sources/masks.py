"""The masks and the template image that volumes are cut with, label logs, listings and CSV output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.operators import series, volume
from volumetra.sources import nifti


def scan_masks(spark: SparkSession, folder: str, least: float = 1.0) -> DataFrame:
    """name, x, y, z: the voxels of at least ``least`` of each mask image in a folder; the name is the file's before its suffixes."""
    grid = nifti.long_form(nifti.scan(spark, folder).where("tr = 0"))
    name = F.substring_index(F.substring_index("path", "/", -1), ".", 1)
    return grid.where(F.col("v") >= least).select(name.alias("name"), "x", "y", "z")


def mask(masks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(voxels, edges) of one mask."""
    one = masks.where(F.col("name") == name).select("x", "y", "z")
    return one, volume.edges(one)


def template(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, v of one image."""
    return nifti.long_form(nifti.scan(spark, path).where("tr = 0")).select("x", "y", "z", "v")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def scan_log(spark: SparkSession, path: str, span: int = 510, k: int = 10) -> DataFrame:
    """path, run, tr, sub, x, y from logs with the columns flag, clock, x and y and no header.

    A clock of 0 starts a new run; each row with flag 1 starts a TR, which is ``k`` samples over that row and the next ``span`` ones of its run.
    Logs are read as one row a file, as their order is that of their lines.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("participant"), "value")
    lines = files.select("participant", F.posexplode(F.split("value", r"\r?\n")).alias("rn", "line")).where("trim(line) <> ''")
    cell = lambda n: F.expr(f"try_cast(trim(split(line, '[,\\t; ]+')[{n}]) as double)")
    rows = lines.select("participant", F.col("rn").cast("long").alias("rn"), cell(0).alias("flag"), cell(1).alias("clock"), cell(2).alias("x"), cell(3).alias("y"))
    return runs_of_log(rows, span, k)


def runs_of_log(rows: DataFrame, span: int, k: int) -> DataFrame:
    """The same from rows (participant, rn, flag, clock, x, y)."""
    marked = series.run_numbers(rows, "clock = 0").withColumn("participant", F.struct("participant", "run"))
    marked = series.renumbered(marked)
    out = series.anchored(marked, "flag = 1", span, k)
    tr = F.dense_rank().over(series.by_time("i0")) - 1
    out = out.withColumn("tr", tr.cast("long"))
    return out.select(F.col("participant.participant").alias("path"), F.col("participant.run").alias("run"), "tr", F.col("j").alias("sub"), "x", "y")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
