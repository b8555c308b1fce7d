"""Session set-up: the workers' import path, and the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for new files below spark.checkpoint.dir; where that is unset, below a temporary folder, in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-framewalk-", dir="/tmp")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def system_of(path: str):
    """(file system, name on it) of a path as Spark writes it, for tasks that open files themselves."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def kept(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to a new folder and read from there: what follows does not compute it again, nor after the loss of an executor."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Removes the files of frames made by kept that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
