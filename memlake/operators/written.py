"""Tables that end a plan's lineage between the levels of a loop, and the shared folder that they lie in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local folder in local mode (tests), else an error, as executors could
    not see one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="memlake-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: a lost executor costs no recomputation, and later joins know its size."""
    path = new_path(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``rows`` by their keys, about ``size`` of them to a task, whatever their number. What is grouped by the keys and more after this, exploded or not, needs
    no other shuffle, and no task groups more than its share."""
    return rows.repartition(rows.count() // size + 1, *keys)
