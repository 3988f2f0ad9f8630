"""A session with the settings that the operators expect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "nucleoframe", **settings: str) -> SparkSession:
    """ANSI mode, UTC, adaptive execution with skew-join handling; `settings` override
    them, with "__" for the dots of a key."""
    base = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    base |= {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=base).getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share: the session's checkpoint folder,
    or, where a local session sets none, one below its warehouse."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints")
    return f"{context.getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: what follows doesn't compute
    it anew, and the copy survives the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
