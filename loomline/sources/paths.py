"""Where files lie: local paths, file:// and s3:// URIs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from loomline.config import Source, scheme_of
from loomline.errors import PipelineError


def is_remote(path: str) -> bool:
    return scheme_of(path) not in (None, "file")


def spark_path(path: str) -> str:
    """The path as Spark reads it: s3:// by the s3a connector, local paths as file: URIs."""
    scheme = scheme_of(path)
    if scheme == "s3":
        return "s3a://" + path.split("://", 1)[1]
    if scheme is None:
        return "file://" + os.path.abspath(path)
    if scheme != "file":
        raise PipelineError(f"source.path storage scheme {scheme}:// is not supported")
    return path


def configure(spark: SparkSession, source: Source) -> None:
    """Sets the object store's endpoint and credentials for a remote source; a wrong one fails here, before any job."""
    if not is_remote(source.path):
        return
    settings = {"endpoint": source.endpoint, "endpoint.region": source.region, "path.style.access": str(source.path_style).lower()}
    for label, setting, name in (("access", "access.key", source.access_key_env), ("secret", "secret.key", source.secret_key_env)):
        value = os.environ.get(name, "")
        if not value.strip():
            raise PipelineError(f"Missing S3 {label} key environment variable: {name}")
        settings[setting] = value
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in settings.items():
        if value:
            hadoop.set(f"fs.s3a.{key}", value)


def read_start(spark: SparkSession, path: str, size: int = 1 << 20) -> bytes | None:
    """The first bytes of a file named as Spark reads it, or null where it doesn't exist."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    try:
        fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop_path) or fs.getFileStatus(hadoop_path).isDirectory():
            return None
        stream = fs.open(hadoop_path)
    except Exception as e:
        if is_remote(path):
            raise PipelineError(f"S3 source read failed at {path.split('://', 1)[1].partition('/')[2]}: {e}") from None
        raise
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path as Spark reads it, bytes) of a file, of the files of a folder, or of those that a pattern fits, by name.

    Of a folder, files in folders below it count too; names with a leading dot or underscore don't.
    """
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(spark_path(path))
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        found = [fs.getFileStatus(hadoop_path)] if fs.exists(hadoop_path) else list(fs.globStatus(hadoop_path) or [])
        out = []
        for status in found:
            if not status.isDirectory():
                out.append(status)
                continue
            root, below = status.getPath().toUri().getPath(), fs.listFiles(status.getPath(), True)
            while below.hasNext():
                each = below.next()
                names = each.getPath().toUri().getPath()[len(root) :].split("/")
                if not any(n.startswith((".", "_")) for n in names):
                    out.append(each)
    except Exception as e:
        if is_remote(path):
            raise PipelineError(f"S3 source read failed at {path.split('://', 1)[1].partition('/')[2]}: {e}") from None
        raise
    return sorted((status.getPath().toString(), status.getLen()) for status in out)
