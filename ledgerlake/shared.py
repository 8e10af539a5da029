"""Folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def root(spark: SparkSession) -> str:
    """Only a local master, as in tests, may do without the setting: elsewhere the warehouse may
    be a folder of one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; its files go when nothing
    refers to it any more."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        context.setCheckpointDir(root(df.sparkSession))
    return df.checkpoint()
