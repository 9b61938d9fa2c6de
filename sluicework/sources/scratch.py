"""Results that several later steps read, written once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder of this session's checkpoints. Where spark.checkpoint.dir names none, a local session gets a
    temporary folder and a cluster, whose executors could not see one, an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written to the folder of the checkpoints and read from there."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)
