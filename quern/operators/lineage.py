"""Cutting lineage: results of a step go to a folder that all executors share, and later steps start from there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A folder of this machine is taken only where none is set and Spark runs in
    this process alone."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: lost executors cost no step before it.

    Spark deletes what was written when nothing refers to it any more, if spark.cleaner.referenceTracking.cleanCheckpoints is true.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
