"""The folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

#: Used only where the session names no checkpoint folder and runs in one process (tests, notebooks).
LOCAL_FALLBACK = "file:///tmp/checkpoints/clickloom"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, removed when the driver's JVM ends; a cluster without that setting is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = (base or LOCAL_FALLBACK).rstrip("/") + f"/clickloom-{uuid.uuid4().hex}"
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(top)
    return path
