"""One CSV or JSONL file, or a folder of part files. Lines are made as one native column and written by tasks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.config import Sink
from loomline.errors import PipelineError
from loomline.functions.strings import col
from loomline.plans.lineage import delete, file_system, scratch
from loomline.schema import POSITION, SEQ, kind_name
from loomline.sources.paths import is_remote, spark_path


def quoted(text: Column) -> Column:
    """A CSV cell: in quotes, its quotes doubled, only where it has a comma, a quote or a line end."""
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(schema: StructType) -> Column:
    """A row as a CSV line; a vector is ``[5.0000 6.0000]``, a null an empty cell."""
    cells = []
    for f in schema.fields:
        kind, c = kind_name(f.dataType), col(f.name)
        if kind == "VECTOR":
            c = F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: F.format_string("%.4f", v)), " "), F.lit("]"))
        cells.append(F.coalesce(quoted(c) if kind == "STRING" else c.cast("string"), F.lit("")))
    return F.concat_ws(",", *cells)


def csv_header(schema: StructType) -> str:
    mark = lambda n: '"' + n.replace('"', '""') + '"' if any(c in n for c in ',"\n\r') else n
    return ",".join(mark(n) for n in schema.fieldNames())


def json_line(schema: StructType) -> Column:
    """A row as a JSON object, fields in order; form feed and backspace are written as \\u escapes."""
    line = F.to_json(F.struct(*[col(n).alias(n) for n in schema.fieldNames()]), {"ignoreNullFields": "false"})
    # The short escapes follow an even number of backslashes; one that is data follows another backslash.
    for short, long in (("b", "0008"), ("f", "000c")):
        line = F.regexp_replace(line, rf"(?<!\\)((?:\\\\)*)\\{short}", rf"$1\\u{long}")
    return line


def write_lines(df: DataFrame, lines: Column, path: str, header: str | None, ordered: bool) -> int:
    """Writes a line for each row as part files of a folder, replacing it, by all tasks at once; gives the number of lines.

    With ``ordered`` the part files, by name, hold the rows in source order. The header comes first in every part.
    """
    rows = df.orderBy(SEQ, POSITION) if ordered else df
    seen = Observation()
    out = rows.select(lines.alias("value")).observe(seen, F.count(F.lit(1)).alias("lines"))
    if header is not None:

        def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([header], pa.string())], ["value"])
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

        out = out.mapInArrow(with_header, "value string")
    out.write.mode("overwrite").text(path)
    return seen.get["lines"]


def commit_of(step: int) -> Column:
    """The commit that a source row belongs to, where commits end each ``step`` rows, counted from row 1."""
    return F.floor((F.col(SEQ) - 1) / step).cast("bigint")


def line_of(sink: Sink, schema: StructType) -> Column:
    return csv_line(schema) if sink.format == "csv" else json_line(schema)


def check_types(schema: StructType) -> None:
    for f in schema.fields:
        if kind_name(f.dataType) not in ("LONG", "STRING", "VECTOR"):
            raise PipelineError(f"File sink does not support field type: {kind_name(f.dataType)}")


class FileSink:
    """One file of the driver's, overwritten or appended to. Tasks write the lines; the driver joins their part files, bytes unread.

    In overwrite mode a sidecar says how long the file was after each commit. A resumed run cuts
    the file back to the last commit before its start and goes on from there, so every row is there
    exactly once; append mode never cuts and may repeat rows. The header comes only to an empty file.
    """

    def __init__(self, sink: Sink, schema: StructType, resume_from: int, show: Callable[[str], None]):
        check_types(schema)
        self.sink, self.schema, self.resume_from = sink, schema, resume_from
        self.sidecar, self.out, self.commits = sink.path + ".offsets", None, None
        #: Rows that are in the file already; the run goes on behind them.
        self.position: int | None = None

    def open(self) -> None:
        path, append = self.sink.path, self.sink.mode == "append"
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        if append:
            self.out = open(path, "ab")
        elif self.resume_from > 1 and (keep := self._committed()) is not None:
            self.position, length = keep
            self.out = open(path, "r+b")
            self.out.truncate(length)
            self.out.seek(0, os.SEEK_END)
        else:
            self.position = 0
            self.out = open(path, "wb")
            if os.path.exists(self.sidecar):
                os.remove(self.sidecar)
        if self.sink.format == "csv" and self.out.tell() == 0:
            self.out.write((csv_header(self.schema) + "\n").encode())
            self.out.flush()
        if not append:
            self.commits = open(self.sidecar, "a")

    def _committed(self) -> tuple[int, int] | None:
        """(number, length) of the last commit up to where the run resumes; lines of the sidecar that make no sense are passed over."""
        best = None
        if os.path.exists(self.sidecar) and os.path.exists(self.sink.path):
            size = os.path.getsize(self.sink.path)
            for line in open(self.sidecar, errors="replace"):
                seq, _, length = line.strip().partition(",")
                if seq.isdigit() and length.isdigit() and int(seq) < self.resume_from and int(length) <= size:
                    best = max(best or (0, 0), (int(seq), int(length)))
        return best

    def write_table(self, df: DataFrame, batch_rows: int, first: int = 1) -> int:
        folder = scratch(df.sparkSession)
        lines = write_lines(df, line_of(self.sink, self.schema), folder, None, ordered=True)
        join_parts(df.sparkSession, [folder], self.out)
        delete(df.sparkSession, folder)
        return lines

    def write_steps(self, df: DataFrame, step: int) -> Iterator[tuple[int, int]]:
        """Tasks write the lines of many commits at once; then gives (commit, lines) of each that has rows as soon as it is in the file."""
        spark, line = df.sparkSession, line_of(self.sink, self.schema)
        sizes = df.groupBy(commit_of(step).alias("k")).agg(F.sum(F.octet_length(line).cast("bigint") + 1), F.count("*")).orderBy("k").collect()  # a row a commit
        folder = scratch(spark)
        if write_lines(df, line, folder, None, ordered=True) != sum(lines for _, _, lines in sizes):
            raise PipelineError("lines were written that are not in the table")
        return self._steps(spark, folder, sizes)

    def _steps(self, spark: SparkSession, folder: str, sizes: list) -> Iterator[tuple[int, int]]:
        blocks, rest = part_blocks(spark, [folder]), memoryview(b"")
        for k, length, lines in sizes:
            while length:
                rest = rest or memoryview(next(blocks))
                self.out.write(rest[:length])
                length, rest = length - len(rest[:length]), rest[length:]
            yield k, lines
        if rest or next(blocks, None):
            raise PipelineError("part files are longer than their lines")
        delete(spark, folder)

    def commit(self, last_seq: int) -> None:
        self.out.flush()
        os.fsync(self.out.fileno())
        if self.commits:
            self.commits.write(f"{last_seq},{self.out.tell()}\n")
            self.commits.flush()

    def close(self) -> None:
        for f in (self.out, self.commits):
            if f:
                f.close()
        if self.commits and self.resume_from <= 0:
            os.remove(self.sidecar)


def part_blocks(spark: SparkSession, folders: list[str], block: int = 1 << 22) -> Iterator[bytes]:
    """The bytes of the part files of folders, in the order of the folders and of their names."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        fs, path = file_system(spark, folder)
        for name in sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")):
            source = jvm.org.apache.hadoop.fs.Path(path, name)
            if folder.startswith("file:"):
                with open(source.toUri().getPath(), "rb") as f:
                    while data := f.read(block):
                        yield data
                continue
            stream = fs.open(source)
            try:
                while data := bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, block))):
                    yield data
            finally:
                stream.close()


def join_parts(spark: SparkSession, folders: list[str], out: BinaryIO) -> None:
    """Appends the part files of folders, in the order of the folders and of their names, to an open file."""
    for data in part_blocks(spark, folders):
        out.write(data)
    out.flush()


class FolderSink:
    """A folder of part files, for results too large for one file: a path that ends in ``/`` or names a remote store.

    What is written of the rows from number n on is a folder ``rows-n`` of it, replaced whole, so that
    writing it again does no harm. A run that starts over clears such folders, a resumed one those
    behind its start. ``only`` confines that to a range of rows: tasks of a job share a folder.
    """

    def __init__(self, sink: Sink, schema: StructType, resume_from: int, show: Callable[[str], None]):
        check_types(schema)
        self.sink, self.schema, self.resume_from, self.only = sink, schema, resume_from, None
        self.ordered, self.header = False, csv_header(schema) if sink.format == "csv" else None
        self.path = spark_path(sink.path).rstrip("/")

    def open(self) -> None:
        spark = SparkSession.active()
        first, last = self.only or (1, 2**63 - 1)
        for number, folder in parts_of(spark, self.path):
            if self.sink.mode != "append" and max(first, self.resume_from) <= number <= last:
                delete(spark, folder)

    def write_table(self, df: DataFrame, batch_rows: int, first: int = 1) -> int:
        name = f"{self.path}/rows-{first:019d}" + (f"-{uuid.uuid4().hex}" if self.sink.mode == "append" else "")
        return write_lines(df, line_of(self.sink, self.schema), name, self.header, self.ordered)

    def commit(self, last_seq: int) -> None:
        pass

    def close(self) -> None:
        pass


def parts_of(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number of the first row, folder) of what a folder sink has written, in order."""
    fs, root = file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted((int(n[5:24]), f"{path}/{n}") for n in names if n.startswith("rows-") and n[5:24].isdigit())


def make(sink: Sink, schema: StructType, resume_from: int, show: Callable[[str], None]) -> FileSink | FolderSink:
    return (FolderSink if sink.path.endswith("/") or is_remote(sink.path) else FileSink)(sink, schema, resume_from, show)
