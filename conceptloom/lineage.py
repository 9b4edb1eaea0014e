"""Cutting lineage in iterative operators through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="conceptloom-"))
    return folder or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed eagerly into ``spark.checkpoint.dir``; only a local master may fall back on a temporary folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def forget(*frames: DataFrame) -> None:
    """Remove the files of ``kept`` frames of which nothing is read any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors, and can be removed by :func:`forget`."""
    spark = df.sparkSession
    path = f"{_folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def merge_union(*frames: DataFrame) -> DataFrame:
    """Union by name of one or more frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
