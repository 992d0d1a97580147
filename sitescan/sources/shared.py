"""Tables that a job keeps between its steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session gets a temporary folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table of the shared folder: its lineage is cut, and a lost executor costs only the tasks that it ran."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables of `kept` that no later step reads."""
    for df in tables:
        if df is not None:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt out by keys over as many tasks as the session shuffles to. Where a step does much for few bytes (a fold in Python), Spark would
    otherwise put its tasks together by their bytes. Groups by these keys need no shuffle of their own."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
