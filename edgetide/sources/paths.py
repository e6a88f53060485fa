"""Shared folders for files that executors write and the driver reads, or the reverse."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from edgetide.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def local(path: str) -> str:
    """A file path for Python's open(): a mount that all machines share."""
    return path[5:].replace("///", "/", 1) if path.startswith("file:") else path


def read_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes of a file in any store that Spark can open."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def file_size(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
