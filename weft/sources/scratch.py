"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, a session that runs on this machine alone uses a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base}/weft-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written and read again, so that what follows doesn't compute it anew."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table that settle() has written for df, once nothing reads it any more."""
    if path := getattr(df, "_weft_path", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
