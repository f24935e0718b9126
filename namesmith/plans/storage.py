"""Tables that cut a job's lineage, kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; on a cluster that fails."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's bytes per Arrow batch from the default, which suits numbers, to one for long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) in ("67108864b", "67108864", "64MB"):
        df.sparkSession.conf.set(key, "8m")
    return df


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    The copy outlives lost executors and stops later jobs from redoing what
    made it. ``remove`` deletes it; else it stays until the folder is emptied.
    Shuffle files of the write are of no more use, and are given up with its end.
    """
    path, conf, key = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, was)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def remove(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that no later job reads; others are left alone."""
    for df in tables:
        if path := getattr(df, "cut_path", None):
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
