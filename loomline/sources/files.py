"""CSV and JSONL files. Every record is checked strictly; a bad one keeps its number and says what is wrong."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loomline.config import Source
from loomline.errors import PipelineError
from loomline.functions.strings import TRIMMED, col, parse_long, trimmed
from loomline.plans.lineage import materialize
from loomline.plans.splits import marks_before
from loomline.schema import ERR, LONG, PIECE, PLACE, SEQ, STRING, field, row_type
from loomline.sources import Numbered, Rows, file_piece, paths, placed

RAW = "_raw"


#: Bytes of a file that are read at first for its schema.
START = 1 << 20
#: Characters of a CSV cell at most: as many as a string can have.
MOST_CHARACTERS = 2**31 - 1
#: What Spark ends a line at, no more.
LINE_END = re.compile(r"\r\n|\r|\n")


def _first(spark: SparkSession, source: Source, find: Callable[[str], tuple | None]) -> tuple | None:
    """(first record, whether more follows it, ...) as ``find`` gives it, of the first file that has one and of as much of it as that takes."""
    files = paths.data_files(spark, source.path)
    if not files:
        raise PipelineError(f"Source file not found: {source.path}")
    for path, length in files:
        size, found = START, None
        while length:
            start = paths.read_start(spark, path, size)
            found = find(start.decode("utf-8", "replace"))
            if len(start) < size or found and found[1]:
                break
            size *= 4
        if found:
            return found
    return None


def first_csv_record(text: str) -> tuple[list[str], bool] | None:
    """The first record that isn't blank, and whether more follows it."""
    csv.field_size_limit(MOST_CHARACTERS)
    stream = io.StringIO(text, newline="")
    record = next((x for x in csv.reader(stream) if x), None)
    return None if record is None else (record, bool(stream.read(1)))


def first_line(text: str) -> tuple[str, bool, int] | None:
    """The first line that isn't blank, whether it is ended, and its number."""
    lines = LINE_END.split(text)
    number = next((i for i, x in enumerate(lines) if x.strip(TRIMMED)), None)
    return None if number is None else (lines[number], number + 1 < len(lines), number + 1)


def read_csv(spark: SparkSession, source: Source) -> Rows:
    """Comma-separated, quoted by double quotes that are doubled within; blank lines are no records.

    The header's names are trimmed; a column called ``id`` is a number, all others are text as
    written. Records with another number of cells, or whose id is no number, are bad records.
    The path may be a folder or a pattern; its files, each with the header, follow each other by
    name. A file of up to ``spark.sql.files.maxPartitionBytes`` is read by one task. A quoted cell
    may hold line ends, so larger files are cut at the ends of their records first (:func:`cut_records`).
    """
    header = _first(spark, source, first_csv_record)
    if not header:
        raise PipelineError(f"CSV file is empty: {source.path}")
    names = [n.lstrip("\ufeff").strip() for n in header[0]]
    if not any(names):
        raise PipelineError(f"CSV header is empty: {source.path}")
    schema = row_type([field(n, LONG if n == "id" else STRING) for n in names])
    raw = StructType([*(StructField(f"_c{i}", StringType()) for i in range(len(names))), StructField(RAW, StringType())])
    options = dict(
        multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        emptyValue="", nullValue="\u0000", enforceSchema=True, maxCharsPerColumn=-1,
    )
    files = paths.data_files(spark, source.path)
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    line, columns, problems = F.col(SEQ) + 1, [], [F.when(F.col(RAW).isNotNull(), F.format_string("Invalid CSV row at line %d: expected %d columns but found %d", F.col(SEQ) + 1, F.lit(len(names)), F.col("_cells")))]
    for i, n in enumerate(names):
        value = F.coalesce(F.col(f"_c{i}"), F.lit(""))  # a trailing empty cell is read as null
        if n == "id":
            problems.append(F.when(parse_long(value).isNull(), F.format_string("Invalid CSV row at line %d: field id is not a long", line)))
            value = parse_long(value)
        columns.append(value.alias(n))

    def number() -> Numbered:
        if all(size <= most for _, size in files):
            read = placed(spark.read.schema(raw).options(header=True, **options).csv([p for p, _ in files]), file_piece())
        else:
            cut = cut_records(spark, [p for p, _ in files])
            cells = F.from_csv("value", raw.simpleString(), {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k not in ("multiLine", "enforceSchema")})
            read = cut.select(PIECE, PLACE, cells.alias("_x")).select(PIECE, PLACE, "_x.*")
        return Numbered(materialize(read.withColumn("_cells", cell_count(F.col(RAW)))))

    return Rows(number, schema, "file", finish=lambda rows: rows.select(SEQ, F.coalesce(*problems).alias(ERR), *columns))


def quoting(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line, given whether one was before it."""
    at, n = 0, len(line)
    while True:
        if not inside:
            if not line.startswith('"', at):  # a cell without quotes ends at the next comma
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at, inside = at + 1, True
        quote = line.find('"', at)
        if quote < 0:
            return True
        if line.startswith('"', quote + 1):
            at = quote + 2
            continue
        inside, at = False, line.find(",", quote) + 1
        if not at:
            return False


def cut_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(piece, place, value) of the CSV records of large files, header and blank lines left out, cut by many tasks.

    Whether a line begins within a quoted cell depends on all lines before it. Each block of lines
    is run through once for both cases at the same time, which gives what it makes of either; these
    answers, one a block, are chained in the order of blocks. A second pass then knows where records
    begin. Records of one line stay where they are; the lines of longer ones are brought together.
    """
    text = spark.read.option("lineSep", "\n").text(files)
    lines = materialize(placed(text.withColumn(PIECE, file_piece()).withColumn("value", F.make_valid_utf8("value")), F.col(PIECE)))
    quoted = lines.where(F.contains("value", F.lit('"'))).select(PIECE, PLACE, "value")

    def turns(rows: pd.DataFrame) -> pd.DataFrame:  # the lines with quotes of one block
        out, if_out, if_in = [], False, True
        for piece, place, value in rows.sort_values(PLACE)[[PIECE, PLACE, "value"]].itertuples(index=False):
            if_out, if_in = quoting(value, if_out), quoting(value, if_in)
            out.append((piece, place, if_out, if_in))
        return pd.DataFrame(out, columns=[PIECE, PLACE, "if_out", "if_in"])

    states = materialize(quoted.groupBy(PIECE).applyInPandas(turns, f"{PIECE} string, {PLACE} bigint, if_out boolean, if_in boolean"))
    ends = {r[0]: (r[1], r[2]) for r in states.groupBy(PIECE).agg(F.max_by("if_out", PLACE), F.max_by("if_in", PLACE)).collect()}  # a row a block
    inside = lambda begins: F.when(begins, F.col("if_in")).otherwise(F.col("if_out"))
    states_of = lambda piece, begins: ends.get(piece, (False, True))[begins]
    begun, open_, before = [], False, None
    for piece in sorted(r[0] for r in lines.select(PIECE).distinct().collect()):
        file = piece.rpartition(":")[0]
        open_, before = open_ and file == before, file  # a file begins outside
        begun.append((piece, open_))
        open_ = states_of(piece, open_)
    known = lines.join(states, [PIECE, PLACE], "left").join(F.broadcast(spark.createDataFrame(begun, f"{PIECE} string, _begins boolean")), PIECE)  # a row a block
    in_order = W.partitionBy(PIECE).orderBy(PLACE)
    after = F.coalesce(F.last(inside(F.col("_begins")), ignorenulls=True).over(in_order.rowsBetween(W.unboundedPreceding, 0)), F.col("_begins"))
    known = known.withColumn("_stays", after).withColumn("_open", F.lag("_stays").over(in_order)).withColumn("_open", F.coalesce("_open", "_begins"))
    starts = ~F.col("_open") & ~F.col("value").isin("", "\r")
    # The number of a record in its block; lines that go on with it have the same one, and 0 is the last record of the block before.
    numbered = materialize(known.withColumn("_record", F.sum(starts.cast("bigint")).over(in_order)).where(F.col("_open") | starts).select(PIECE, PLACE, "_record", "value", "_open", "_stays"))
    last = {r[0]: r[1] for r in numbered.groupBy(PIECE).agg(F.max("_record")).collect()}
    carried, latest = [], None
    for piece, open_ in begun:
        carried.append((piece, *(latest if open_ and latest else (piece, 0))))
        latest = (piece, last[piece]) if last.get(piece) else latest
    homes = F.broadcast(spark.createDataFrame(carried, f"{PIECE} string, _home string, _number bigint"))  # a row a block
    inner = F.col("_record") > 0
    whole = numbered.where(~F.col("_open") & ~F.col("_stays")).select(PIECE, F.col("_record").alias(PLACE), "value")
    parts = numbered.where(F.col("_open") | F.col("_stays")).join(homes, PIECE).select(
        F.when(inner, F.col(PIECE)).otherwise(F.col("_home")).alias("_home"), F.when(inner, F.col("_record")).otherwise(F.col("_number")).alias("_number"), F.struct(PIECE, PLACE, "value").alias("_line")
    )
    joined = parts.groupBy("_home", "_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_line")), lambda x: x.value), "\n").alias("value"))
    records = whole.unionByName(joined.select(F.col("_home").alias(PIECE), F.col("_number").alias(PLACE), "value"))
    header = F.col(PIECE).endswith(":" + "0" * 20) & (F.col(PLACE) == 1)
    return records.where(~header).select(PIECE, PLACE, F.regexp_replace("value", r"\r\z", "").alias("value"))


@F.pandas_udf(IntegerType())
def cell_count(records):  # noqa: ANN001, ANN201
    """Cells of a raw record; asked only for those that don't fit."""
    csv.field_size_limit(MOST_CHARACTERS)
    return records.map(lambda r: None if r is None else len(next(csv.reader(io.StringIO(r, newline="")), [])))


def read_jsonl(spark: SparkSession, source: Source) -> Rows:
    """One JSON object a line; blank lines are no records, bytes that are no UTF-8 become U+FFFD.

    The first object gives the fields, in its order: ``id`` and whole numbers are numbers, other
    scalars text. It must be sound, whatever the error policy. Later lines must have these fields
    and no others, each a scalar; of a repeated field the last counts. Lines are split by Spark.
    The path may be a folder or a pattern; its files follow each other by name.
    """
    first = _first(spark, source, first_line)
    if not first:
        raise PipelineError(f"JSONL file is empty: {source.path}")
    line, _, number = first
    fields = [field(n, LONG if n == "id" or isinstance(v, int) and not isinstance(v, bool) else STRING) for n, v in first_object(line, number).items()]
    schema = row_type(fields)

    def count_lines() -> Numbered:
        text = spark.read.text([p for p, _ in paths.data_files(spark, source.path)])
        checked = check_lines(text.withColumn(PIECE, file_piece()).withColumn("value", F.make_valid_utf8("value")), fields)
        lines = Numbered(materialize(placed(checked, F.col(PIECE))), "_line")
        blank = F.col("_blank")
        if not lines.table.where(blank).limit(1).count():
            lines.number = SEQ
            return lines
        # Blank lines have a line number but none in the sequence of records.
        counted = marks_before(lines.between(), blank, [], "_line").where(~blank)
        numbers = counted.withColumn(SEQ, F.col("_line") - F.col("_marks"))
        return _Given(materialize(numbers.drop("_marks", "_last")), lines.total)

    def finish(rows: DataFrame) -> DataFrame:
        line = (F.col("_line") if "_line" in rows.columns else F.col(SEQ)).cast("string")
        return rows.select(SEQ, F.concat(F.lit("Invalid JSONL row at line "), line, F.lit(": "), F.col(ERR)).alias(ERR), *(col(f.name) for f in fields))

    return Rows(count_lines, schema, "file", finish=finish)


class _Given(Numbered):
    """Rows that have their numbers stored."""

    def __init__(self, table: DataFrame, total: int):
        self.table, self.total = table, total

    def between(self, first: int = 1, last: int = 2**63 - 1) -> DataFrame:
        return self.table.where(F.col(SEQ).between(first, last))


def first_object(line: str, number: int) -> dict:
    where = f"Invalid JSONL row at line {number}"
    try:
        found, _ = json.JSONDecoder().raw_decode(line.strip())
    except ValueError:
        raise PipelineError(f"{where}: malformed JSON") from None
    if not isinstance(found, dict):
        raise PipelineError(f"{where}: expected JSON object")
    if not found:
        raise PipelineError(f"{where}: expected at least one field")
    for name, value in found.items():
        if not name.strip():
            raise PipelineError(f"{where}: field name must not be empty")
        if value is None:
            raise PipelineError(f"{where}: field {name} must not be null")
        if isinstance(value, (dict, list)):
            raise PipelineError(f"{where}: field {name} must be a scalar value")
    return found


def check_lines(rows: DataFrame, fields: list[StructField]) -> DataFrame:
    """``rows`` with ``value`` -> (other columns, _err, _blank, fields): the values of each line and the first thing wrong with it.

    ``from_json`` takes the last of repeated fields and leaves what follows the object alone. All
    values are read as text; whether a value is nested is told by its type, not by its text.
    """
    value = F.col("value")
    others = [c for c in rows.columns if c != "value"]
    rows = rows.withColumn("_map", F.from_json(value, F.lit("map<string,string>"))).withColumn("_keys", F.json_object_keys(value))
    bare = trimmed(value)
    problems = [
        F.when(F.col("_map").isNull() & bare.rlike(r"^(\[|\"|-?[0-9]|true|false|null)") & F.get_json_object(value, "$").isNotNull(), F.lit("expected JSON object")),
        F.when(F.col("_keys").isNull() | F.col("_map").isNull(), F.lit("malformed JSON")),
    ]
    known = F.filter(F.col("_keys"), lambda k: ~k.isin([f.name for f in fields]))
    problems.append(F.when(F.size(known) > 0, F.concat(F.lit("unexpected field "), F.try_element_at(known, F.lit(1)))))
    columns = []
    for f in fields:
        raw = F.try_element_at(F.col("_map"), F.lit(f.name))
        problems.append(F.when(~F.array_contains("_keys", f.name), F.lit(f"missing field {f.name}")))
        # Only text that could be an object or array is parsed again, with its types.
        typed = F.from_json(F.when(raw.rlike(r"^\s*[\[{]"), value), "map<string,variant>")
        nested = F.schema_of_variant(F.try_element_at(typed, F.lit(f.name))).rlike("^(OBJECT|ARRAY)")
        problems.append(F.when(nested, F.lit(f"field {f.name} must be a scalar value")))
        problems.append(F.when(raw.isNull(), F.lit(f"field {f.name} must not be null")))
        if f.dataType == LONG:
            problems.append(F.when(parse_long(raw).isNull(), F.lit(f"field {f.name} is not a long")))
            columns.append(parse_long(raw).alias(f.name))
        else:
            columns.append(raw.alias(f.name))
    return rows.select(*others, F.coalesce(*problems).alias(ERR), (F.length(bare) == 0).alias("_blank"), *columns)
