"""Intermediate tables in the folder that all executors share."""

import contextlib
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a fresh folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tabulant-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_open = threading.local()  # the paths of the scope that is open, if any


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Removes at its end every table that this thread wrote inside it; what is read from them must be stored before.

    Scopes nest: the inner one removes its own tables only.
    """
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        mine, _open.paths = _open.paths, outer
        for path in mine:
            discard(spark, path)


def materialize(df: DataFrame, name: str, partition_by=()) -> tuple[DataFrame, str]:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str | None) -> None:
    """Remove a table written by ``materialize``."""
    if path is None:
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
