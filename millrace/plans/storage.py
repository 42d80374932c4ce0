"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of written tables beside the checkpoints.
TABLES = "millrace-tables"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: that of the context, or the one named in spark.checkpoint.dir.

    Executors must all see it, so none is made up on a cluster where neither is set. In local mode, as in tests, driver and
    executors are one process, and a temporary folder will do.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = os.path.join(tempfile.gettempdir(), "millrace-checkpoints")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read it from there ever after."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table in that folder, of which later steps read only the columns that they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{TABLES}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``stored`` wrote in this session's folder. Results that still read them fail afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{TABLES}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
