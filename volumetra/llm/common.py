"""Helpers shared by the text operators: shared-folder tables and word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on one machine (a local master, as in tests) a temporary folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="volumetra-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/volumetra/{name}-{uuid.uuid4().hex}"


#: Tables written within each open ``scratch``, the innermost last.
_open: list[dict[str, bool]] = []


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    This cuts the lineage: what follows survives the loss of executors without recomputing ``df``,
    and the planner sees the written size, so it broadcasts only what it has measured to be small. The table stays
    until the ``scratch`` around it ends.
    """
    return table_of([df], name)


def table_of(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """One ``table`` of all the parts, which are written one after the other."""
    path = ""
    for df in parts:
        if not path:
            path = new_path(df.sparkSession, name)
            if _open:
                _open[-1][path] = False
        df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables written within, but for those passed to the yielded function; these belong to the scratch around, if there is one.

    What is read lazily after the end must be kept, or be written to a kept table before.
    """
    own: dict[str, bool] = {}
    _open.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own[df.table_path] = True
        return df

    try:
        yield keep
    finally:
        _open.remove(own)
        for path, kept in own.items():
            if not kept:
                delete(spark, path)
            elif _open:
                _open[-1][path] = False


@contextmanager
def no_leftovers(spark: SparkSession) -> Iterator[None]:
    """Queries run within delete their shuffle files when they end. By default these stay until the driver happens to collect its garbage, however full the disks are."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lean(run: Callable) -> Callable:
    """``run`` over batches, after which the worker gives back what memory it no longer uses: workers live on, and what they hold adds up over the stages of a job."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
