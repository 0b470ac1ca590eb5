"""Cutting lineage between the rounds of an iterative operator, and a place for files in between."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it Spark deletes a checkpoint's files once nothing refers to the table any more.
_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir), which driver and executors share.

    One is made and set only under a local master whose session names none, as
    in tests; on a cluster that raises RuntimeError.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="riverine-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder; a lost executor costs a re-read.

    The files go when no table that was made from it is left: a fixpoint keeps
    the states of a few rounds and not of all.  What the optimizer had inferred
    about the plan isn't handed on: its estimated sizes are products of those
    before, numbers of twice the digits in every round.  Adaptive execution
    measures the sizes anyway.
    """
    spark = df.sparkSession
    shared_folder(spark)
    conf = spark.sparkContext._jsc.sc().conf()
    was = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        kept = df.checkpoint()
    finally:
        conf.set(_CLEAN, was)
    rows = kept._jdf.queryExecution().logical().rdd()
    return type(kept)(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
