"""Tables on the way: what is used again, or would carry a long lineage, is checkpointed in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed once and read back from the session's ``spark.checkpoint.dir``, so that the loss of executors costs nothing.

    Only where that setting is absent and all runs on one machine (a local master, as in tests) a temporary folder is set. Spark deletes checkpoints that nothing refers to if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="volumetra-"))
    return df.checkpoint()
