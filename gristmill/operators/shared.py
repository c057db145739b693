"""Tables written to the shared folder between the rounds of an iteration."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder that spark.checkpoint.dir names; where it names none, in a temporary one."""
    folder_of(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df from compressed files in the same folder: a checkpoint holds rows as they are in memory."""
    df.write.option("compression", "zstd").parquet(path := f"{folder_of(df.sparkSession)}/gristmill/{name}-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets go of shuffle files of finished jobs now, not when the driver's JVM happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def folder_of(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not folder:
            atexit.register(shutil.rmtree, folder := tempfile.mkdtemp(prefix="gristmill-"), True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()
