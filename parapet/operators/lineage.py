"""Cutting a plan: results are written once to reliable shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, for checkpoints and written tables.

    The session names it in ``spark.checkpoint.dir``; nothing is written to a
    folder that nobody named.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and context.getCheckpointDir() is not None:
        configured = context.getCheckpointDir()
    if configured is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there.

    What follows reads the stored rows: nothing upstream runs twice, and a lost
    executor costs a re-read, not a recomputation.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
