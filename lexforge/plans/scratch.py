"""Folders and small files beside the checkpoints for queries that show a source or a sink."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from ..session import shared_folder


def _file_system(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, deleted when this program ends, as results are read from it."""
    where = os.path.join(shared_folder(spark), f"lexforge-{uuid.uuid4().hex}")
    path, files = _file_system(spark, where)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return where


def put(spark: SparkSession, where: str, content: str | bytes) -> None:
    """A small file with this content."""
    path, files = _file_system(spark, where)
    out = files.create(path, True)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()
