"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, read from the session.

    Where it is unset (local tests), a temporary folder of our own is set as
    the checkpoint directory of the session.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    own = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    sc.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, label: str) -> str:
    """A name in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/siltstone-{label}-{uuid.uuid4().hex}"
