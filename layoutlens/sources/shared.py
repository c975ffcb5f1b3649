"""The folder that a cluster shares, and frames kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the one that the cluster shares; one of our own is set only where none is configured (tests)."""
    context = spark.sparkContext
    if not (root := spark.conf.get("spark.checkpoint.dir", None)):
        held = context._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="layoutlens-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(frame: DataFrame) -> DataFrame:
    """The frame as a checkpoint in the shared folder, made once for all that is taken from it.

    Spark deletes it when nothing refers to it any more if `spark.cleaner.referenceTracking.cleanCheckpoints` is set.
    """
    shared_folder(frame.sparkSession, "kept")
    return frame.checkpoint()
