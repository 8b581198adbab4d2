"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_runs: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local master, where one machine holds everything, may go without the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = os.path.join(tempfile.gettempdir(), "gramloom-checkpoints")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _delete(folder: str) -> None:
    try:
        store, path = file_system(folder)
        store.delete_dir(path)
    except (OSError, pa.ArrowException):  # never made, or in a store that only Spark reaches
        pass


def new_path(spark: SparkSession) -> str:
    """A path that nothing has used, in this application's own folder; that folder goes when the driver ends."""
    folder = f"{shared_folder(spark)}/gramloom-{spark.sparkContext.applicationId}"
    if folder not in _runs:
        _runs.add(folder)
        atexit.register(_delete, folder)
    return f"{folder}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and lost executors cost nothing of it."""
    path = f"{new_path(df.sparkSession)}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
