"""Pipelines over files that keep arriving, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomline.config import Transform
from loomline.operators.transforms import Chain


def stream_folder(
    spark: SparkSession, folder: str, schema: StructType, transforms: list[Transform], write: Callable[[DataFrame, int], None], checkpoint: str, form: str = "json", files_per_batch: int = 1000, available_now: bool = True
) -> StreamingQuery:
    """Runs the transforms over each file of a folder once, however often the query is started.

    Micro-batches of up to ``files_per_batch`` files go to ``write(df, batch_id)``, which should
    be idempotent by the batch id or by the rows' ids, as a batch can come again after a failure.
    With ``available_now`` the query ends when all files there are have been read.
    """
    chain = Chain(transforms, schema)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(folder)
    writer = chain(arriving).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Rows per window and keys of a stream (or table) of events; later ones than ``lateness`` are dropped from a stream."""
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, lateness).groupBy(frame, *keys).agg(F.count("*").alias("rows")).select(F.col("window.start").alias("start"), *keys, "rows")


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str, lateness: str) -> DataFrame:
    """Rows per session and keys of a stream (or table) of events; a session ends when nothing comes for ``gap``."""
    counted = events.withWatermark(time, lateness).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("rows"))
    return counted.select(F.col("session_window.start").alias("start"), *keys, "rows")
