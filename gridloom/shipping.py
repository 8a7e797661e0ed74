"""What a session needs before Python workers run the library: its code, and batches that fit long texts."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_sent: set[str] = set()
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package to the session's workers, once an application. A session that leaves the rows of an Arrow
    batch at Spark's default gets fewer: ten thousand long texts at once, in the JVM and again in Python, are much
    of an executor's memory."""
    sc = spark.sparkContext
    if spark.conf.get(ROWS, "10000") == "10000":
        spark.conf.set(ROWS, "1000")
    if sc.applicationId not in _sent:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(here):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("gridloom", os.path.relpath(full, here)))
        sc.addPyFile(path)
        _sent.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which ``spark.checkpoint.dir`` names. A session on one machine may
    leave it unset and gets a temporary one; on a cluster that is an error, as its machines share no such folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="gridloom-")
    return path


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and cut from its lineage; survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    # as other columns than those of ``df``, so that it may be joined to what it came from
    return out.select(*(F.col(f"`{c}`").alias(c) for c in out.columns))
