"""The folder every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


FOLDER = "labelquality.shared.dir"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder named in spark.checkpoint.dir or, where that is unset, in FOLDER, which can be set while a session runs.

    One of them must be set: a folder of one machine would be lost with that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(FOLDER, None)
    if not root:
        raise ValueError(f"set spark.checkpoint.dir or {FOLDER} to a folder all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, computed once and read back from a table in the shared folder.

    Later steps restart from the table, so a lost executor does not undo the work before it.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
