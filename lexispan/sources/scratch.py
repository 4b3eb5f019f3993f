"""Intermediates of iterative jobs, written to the shared folder so that lost executors cost their tasks only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only where Spark itself is local and the setting isn't there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _own:
        _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="lexispan-")
    return _own[spark.sparkContext.applicationId]


def written(df: DataFrame, label: str) -> DataFrame:
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
