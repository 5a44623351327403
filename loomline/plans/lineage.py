"""Cutting lineage with tables that every executor can read again.

A materialised table lives in the folder named by ``spark.checkpoint.dir``. Losing an
executor costs nothing but a re-read: unlike a local checkpoint no block exists only once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables made in the innermost :func:`scope`, if there is one.
_made: ContextVar[list[str] | None] = ContextVar("loomline_made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where none is configured, as in tests, a temporary one is set.

    A machine-local temporary folder is refused on anything but a local master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="loomline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(Hadoop file system, path) of a path."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def scratch(spark: SparkSession, suffix: str = "") -> str:
    """A new folder name in the shared folder. It goes with the scope it was made in, at the latest when the application ends."""
    path = f"{shared_dir(spark)}/loomline-{uuid.uuid4().hex}{suffix}"
    fs, hadoop_path = file_system(spark, path)
    fs.deleteOnExit(hadoop_path)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return a scan of it.

    Gives non-deterministic columns (generated ids) one value for good, and lets a result be
    read by several consumers, each with its own column pruning, without recomputation.
    :func:`release` or the end of the :func:`scope` deletes the files.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._loomline_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more; other tables are let be."""
    for table in tables:
        if path := getattr(table, "_loomline_path", None):
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = file_system(spark, path)
    fs.delete(hadoop_path, True)
    fs.cancelDeleteOnExit(hadoop_path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was materialised within it: for runs that give no table back."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)
