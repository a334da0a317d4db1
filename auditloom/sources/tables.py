"""Tables as Parquet files."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, and new: what a replacing write leaves. A null key matches none and stays."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Where nothing names one, a temporary folder is set if all runs in this one process, as in tests; on a cluster that
    is an error, as a folder of one machine is lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith(("local[", "local*")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to shared_folder() and read again, so that what follows neither repeats nor keeps its plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
