"""A session with the settings that every plan here relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and cut off from its plan: a checkpoint in the folder that spark.checkpoint.dir names, or in one of our own on a local master."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="corpusgraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("corpusgraph")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
