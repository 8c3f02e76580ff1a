"""Tables that are written to the folder that the driver and all executors share, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, or the session by ``setCheckpointDir``.

    Where neither is set, a session on one machine, as in tests, gets a temporary
    folder; on a cluster that's an error, as executors don't see the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("no shared folder: set spark.checkpoint.dir to one that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at a path, read again: its plan is computed once and later plans begin there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to a new folder of the shared one, and that folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    return written(df, path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that no plan reads any more, where it is there."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
