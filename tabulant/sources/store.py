"""Saving and loading fitted models: JSON metadata next to parquet weights.

A stored model is a folder of ``versions`` and of commits.  A version is written whole before an empty
file in ``commits`` names it; the latest commit is what loads.  So a save that breaks off leaves the model
before it readable, and a loaded model that reads its rows from the folder can be stored over itself.
Earlier versions stay, since models loaded from them may be in use, until ``prune_versions`` removes them.
"""

import uuid

import numpy as np
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import SparkSession

WEIGHTS = "name string, shape array<int>, data array<double>"


def save_weights(spark: SparkSession, weights: dict, path: str) -> None:
    """One row per parameter."""
    rows = [(k, [int(s) for s in v.shape], [float(x) for x in v.ravel()]) for k, v in weights.items()]
    spark.createDataFrame(rows, WEIGHTS).write.parquet(path)


def load_weights(spark: SparkSession, path: str, dtype=np.float32) -> dict:
    rows = spark.read.schema(WEIGHTS).parquet(path).collect()
    return {r["name"]: np.array(r["data"], dtype).reshape(r["shape"]) for r in rows}


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def commits(spark: SparkSession, path: str) -> list[str]:
    """The committed versions at ``path``, oldest first."""
    fs, target = _folder(spark, f"{path}/commits")
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _folder(spark, path)
    return fs.exists(target)


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that loads; a model stored without versions is its own folder."""
    done = commits(spark, path)
    if not done and _exists(spark, f"{path}/versions"):
        raise ValueError(f"{path} does not hold a whole model")
    return f"{path}/versions/{done[-1]}" if done else path


def prune_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all but the ``keep`` latest versions, and what saves that broke off left.

    No model loaded from an earlier version and no save to ``path`` may be in use.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    done = commits(spark, path)
    if not done:
        return
    kept = done[-keep:]
    fs, versions = _folder(spark, f"{path}/versions")
    for name in done:
        if name not in kept:
            fs.delete(_folder(spark, f"{path}/commits/{name}")[1], False)
    for found in fs.listStatus(versions):
        if found.getPath().getName() not in kept:
            fs.delete(found.getPath(), True)


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def _handleOverwrite(self, path):
        """The same kind of model gets a new version; anything else at ``path`` is removed."""
        spark = self.sparkSession
        if commits(spark, path):
            stored = DefaultParamsReader.loadMetadata(current(spark, path), spark)
            if stored.get("kind") == self.instance.kind:
                return
        super()._handleOverwrite(path)

    def saveImpl(self, path):
        spark = self.sparkSession
        done = commits(spark, path)
        broken_off = not done and _exists(spark, f"{path}/versions")
        if not self.shouldOverwrite and not broken_off and _exists(spark, path):
            raise FileExistsError(f"{path} already exists; use write().overwrite() for a new version")
        extra = {"kind": self.instance.kind, "content": self.instance._content()}
        number = int(done[-1].split("-")[0]) + 1 if done else 0
        name = f"{number:012d}-{uuid.uuid4().hex}"
        version = f"{path}/versions/{name}"
        DefaultParamsWriter.saveMetadata(self.instance, version, spark, extraMetadata=extra)
        self.instance._save_parts(version, spark)
        # a pipeline reads the class of its stages here
        if not done:
            _remove(spark, f"{path}/metadata")
            DefaultParamsWriter.saveMetadata(self.instance, path, spark, extraMetadata={"kind": self.instance.kind})
        fs, commit = _folder(spark, f"{path}/commits/{name}")
        fs.create(commit, False).close()


def _remove(spark: SparkSession, path: str) -> None:
    fs, target = _folder(spark, path)
    fs.delete(target, True)


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        spark = self.sparkSession
        version = current(spark, path)
        metadata = DefaultParamsReader.loadMetadata(version, spark)
        if metadata.get("kind") != self.cls.kind:
            raise ValueError(f"{path} does not hold a {self.cls.kind}")
        instance = self.cls._from_parts(metadata["content"], version, spark)
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        return instance


class Stored(MLReadable, MLWritable):
    """Mixin: ``kind``, ``_content() -> json``, ``_save_parts`` and ``_from_parts``."""

    kind = ""

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)
