"""Sinks. An ordered sink gets batches of rows on the driver, in source order; a parallel one writes from tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from loomline.config import Sink
from loomline.errors import PipelineError
from loomline.schema import kind_name


class OrderedSink(Protocol):
    """Batches arrive on the driver one after the other. ``render`` makes the columns a batch needs, on the executors."""

    def open(self) -> None: ...
    def render(self, df: DataFrame) -> DataFrame: ...
    def write(self, rows: list, last_seq: int) -> None: ...
    def close(self) -> None: ...


class ParallelSink(Protocol):
    """Writes a table from its tasks. Tasks can run twice, so writing a row again must do no harm.

    ``first`` is the number of the first source row behind the table. A sink that counts the rows it
    has written gives their number, which is then held against the table's. ``commit(last_seq)``, where
    there is one, makes what was written up to a source row last, before the checkpoint says so;
    ``position``, where there is one, is the source row that a sink goes on behind when it is opened.
    """

    def open(self) -> None: ...
    def write_table(self, df: DataFrame, batch_rows: int, first: int = 1) -> int | None: ...
    def close(self) -> None: ...


Maker = Callable[[Sink, StructType, int, Callable[[str], None]], OrderedSink | ParallelSink]
#: Makers of sinks by type, beside the built-in ones; added by :func:`register`.
REGISTERED: dict[str, Maker] = {}


def register(name: str, make: Maker) -> None:
    REGISTERED[name] = make


def require(schema: StructType, name: str, kind: str, label: str) -> None:
    found = next((f for f in schema.fields if f.name == name), None)
    if found is None or kind_name(found.dataType) != kind:
        raise PipelineError(f"{label} sink requires {kind} field: {name}")


def create(sink: Sink, schema: StructType, resume_from: int, show: Callable[[str], None]) -> OrderedSink | ParallelSink:
    """The sink of a pipeline with its fields checked; nothing is written before it is opened."""
    from loomline.sinks import console, file, vector

    built_in: dict[str, Maker] = {
        "console": console.Console,
        "mock-vector": console.MockVector,
        "file": file.make,
        "qdrant": vector.Qdrant,
        "milvus": vector.Milvus,
        "pgvector": vector.Pgvector,
    }
    make = built_in.get(sink.type) or REGISTERED.get(sink.type)
    if make is None:
        raise PipelineError(f"Unsupported sink.type: {sink.type}")
    return make(sink, schema, resume_from, show)
