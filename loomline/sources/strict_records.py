"""Strict loading of delimited records: valid rows are loaded, the rest come out with a reason.

Loading is strict and native: one expression tells whether a record has exactly two cells, sound
quoting and valid values. What was not loaded is found by an anti-join on the record offsets, so
that nothing can be lost between the two outputs, and only this remainder is diagnosed cell by cell.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.errors import PipelineError

# What counts as white space of a blank name.
BLANK = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
INTEGER = r"^[ \t]*[+-]?[0-9]+[ \t]*\z"
REPLACEMENT = "\ufffd"
LOW, HIGH = -(2**63), 2**63 - 1


def without_line_end(record: Column) -> Column:
    """The record less one closing CRLF, LF or CR."""
    return F.regexp_replace(record, r"(\r\n|\n|\r)\z", "")


def _cut_cell(rows: DataFrame, rest: str, cell: str, end: str) -> DataFrame:
    """Adds the first cell of column ``rest``, unquoted, and the position behind it; 0 where its quoting is broken.

    Behind the opening quote, doubled quotes are masked pair by pair from the left; the first
    quote left is the closing one. No regular expression, so that no length overflows a stack.
    Each step is a column of its own, computed once.
    """
    r, quoted = F.col(rest), F.startswith(rest, F.lit('"'))
    rows = rows.withColumn("_closing", F.when(quoted, F.instr(F.replace(F.substr(r, F.lit(2)), F.lit('""'), F.lit("xx")), '"')).otherwise(F.instr(r, ",")))
    sound = (F.col("_closing") > 0) & F.substr(r, F.col("_closing") + 2, F.lit(1)).isin("", ",")
    plain = F.when(F.col("_closing") > 0, F.col("_closing")).otherwise(F.length(r) + 1)
    rows = rows.withColumn(end, F.when(~quoted, plain).when(sound, F.col("_closing") + 2).otherwise(0))
    inner = F.replace(F.substr(r, F.lit(2), F.greatest(F.col(end) - 3, F.lit(0))), F.lit('""'), F.lit('"'))
    return rows.withColumn(cell, F.when(quoted, inner).otherwise(F.substr(r, F.lit(1), F.greatest(F.col(end) - 1, F.lit(0)))))


def load_valid(records: DataFrame, offset: str = "rec_id", record: str = "record") -> DataFrame:
    """(offset, id, name) of the records that conform. Native expressions only, no shuffle.

    The verdict is a generator that gives one row or none. A filter would be pushed below the
    steps above and repeat their expressions.
    """
    missing = F.raise_error(F.lit(f"A record has no {offset}")).cast(records.schema[offset].dataType)
    rows = records.select(F.coalesce(offset, missing).alias("_offset"), without_line_end(F.col(record)).alias("_r"))
    rows = _cut_cell(rows, "_r", "_number", "_end")
    rows = rows.withColumn("_rest", F.substr("_r", F.col("_end") + 1))
    rows = _cut_cell(rows, "_rest", "_name", "_stop")
    two = (F.col("_end") > 0) & (F.col("_end") <= F.length("_r")) & (F.col("_stop") == F.length("_rest") + 1)
    rows = rows.withColumn("_id", F.when(two & F.col("_number").rlike(INTEGER), F.col("_number").try_cast("bigint")))
    seen = F.col("_name").rlike(f"[^{BLANK}]") & ~F.contains("_name", F.lit(REPLACEMENT))
    good = F.when(F.col("_id").isNotNull() & seen, F.array(F.struct(F.col("_id").alias("id"), F.col("_name").alias("name"))))
    return rows.select(F.col("_offset").alias(offset), F.inline(good))


_CLOSE = re.compile(r"\r\n\Z|\n\Z|\r\Z")
_BLANK = re.compile(f"[{BLANK}]*\\Z")
_INTEGER = re.compile(r"[ \t]*[+-]?[0-9]+[ \t]*\Z")


def cells_of(record: str) -> list[str] | None:
    """All cells of a record, or null where the quoting is broken. Linear in the record's length."""
    record = _CLOSE.sub("", record)
    cells, at, n = [], 0, len(record)
    while True:
        if record.startswith('"', at):
            parts, start = [], at + 1
            while True:
                quote = record.find('"', start)
                if quote < 0:
                    return None
                parts.append(record[start:quote])
                if record.startswith('"', quote + 1):
                    parts.append('"')
                    start = quote + 2
                    continue
                at = quote + 1
                break
            if at < n and record[at] != ",":
                return None
            cells.append("".join(parts))
        else:
            comma = record.find(",", at)
            stop = n if comma < 0 else comma
            cells.append(record[at:stop])
            at = stop
        if at >= n:
            return cells
        at += 1


def reason_of(record: str | None) -> str | None:
    """Why a record fails, the first of quoting, column_count and value that applies; null where it doesn't."""
    cells = [] if record is None else cells_of(record)
    if cells is None:
        return "quoting"
    if len(cells) != 2:
        return "column_count"
    digits = cells[0].strip(" \t").lstrip("+-").lstrip("0")
    if not _INTEGER.match(cells[0]) or len(digits) > 19 or not LOW <= int(cells[0]) <= HIGH:
        return "value"
    if _BLANK.match(cells[1]) or REPLACEMENT in cells[1]:
        return "value"
    return None


def failed_records(records: DataFrame, offset: str = "rec_id", record: str = "record") -> DataFrame:
    """(offset, reason) of every record that :func:`load_valid` doesn't load, second deliveries included.

    Offsets are unique (the record's place in the raw input); a null one is an error. A null record has no
    cell and fails by column_count, as does an empty one, which has one cell. Extra columns are
    not read. An empty table gives no row.
    """
    loaded = load_valid(records, offset, record).select(offset)
    remainder = records.select(offset, record).join(loaded, offset, "left_anti")
    kind = remainder.schema[offset].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = [reason_of(r) for r in batch.column(1).to_pylist()]
            if None in reasons:  # a defect of the strict load or of these rules, never of the data
                raise PipelineError(f"Record {batch.column(0)[reasons.index(None)]} was not loaded, but nothing is wrong with it")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reasons, pa.string())], [offset, "reason"])

    return remainder.mapInArrow(run, f"`{offset}` {kind}, reason string")
