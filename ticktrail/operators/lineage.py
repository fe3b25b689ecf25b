"""Cutting lineage: running values read their input twice, so stacks of them would read it ever again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df to the folder that spark.checkpoint.dir names and reads it again; what is written outlives executors. In
    local mode a temporary folder stands in for a missing setting; on a cluster it is an error."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="ticktrail-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
