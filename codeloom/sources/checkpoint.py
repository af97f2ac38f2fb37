"""Lineage cuts for iterative operators, and the folder that all machines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only on a local master (tests).

    On a cluster without that setting this raises: a machine-local folder would be another one on each machine.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return at or "file:///tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder. ``drop`` deletes it once nothing reads it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
