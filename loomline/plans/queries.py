"""Registered queries over the test tables and the SQL they are held against."""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import sqlite3
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline import config, sinks
from loomline.config import Pipeline, Sink, Source, Transform
from loomline.errors import ConfigError, PipelineError, StageError
from loomline.functions.strings import utf16_length
from loomline.operators import embedding
from loomline.operators.transforms import Chain
from loomline.plans import jobs, runner, splits, state
from loomline.plans.lineage import delete, file_system, materialize, scratch, shared_dir
from loomline.schema import BATCH, ERR, LONG, PIECE, PLACE, POSITION, SEQ, STRING, VECTOR, field, row_type
from loomline.sinks import console, file, vector
from loomline.sources import Numbered, Rows, demo, open_source, placed, strict_records
from loomline.sources import register as register_source
from loomline.streaming import incremental

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Strict loading ------------------------------------------------------------------------------

CELL = '(?:"(?:[^"]|"")*"|[^",][^,]*|)'
RECORDS = f"""
WITH r AS (SELECT rec_id, regexp_replace(record, '(\\r\\n|\\n|\\r)\\z', '') AS r FROM input_records),
c AS (SELECT rec_id, r,
    regexp_full_match(r, '{CELL}(?:,{CELL})*') AS sound,
    regexp_full_match(r, '{CELL},{CELL}') AS two,
    regexp_extract(r, '^({CELL}),({CELL})\\z', 1) AS a,
    regexp_extract(r, '^({CELL}),({CELL})\\z', 2) AS b FROM r),
u AS (SELECT rec_id, sound, two,
    CASE WHEN a LIKE '"%' THEN replace(substr(a, 2, length(a) - 2), '""', '"') ELSE a END AS a,
    CASE WHEN b LIKE '"%' THEN replace(substr(b, 2, length(b) - 2), '""', '"') ELSE b END AS b FROM c),
v AS (SELECT rec_id, sound, two, b AS name,
    CASE WHEN regexp_full_match(a, '[ \\t]*[+-]?[0-9]+[ \\t]*')
         THEN try_cast(replace(trim(a, chr(9) || ' '), '+', '') AS BIGINT) END AS id,
    regexp_matches(b, '[^\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')
      AND NOT contains(b, chr(65533)) AS seen FROM u)
"""


@query(
    RECORDS
    + """SELECT rec_id, CASE WHEN NOT sound THEN 'quoting' WHEN NOT two THEN 'column_count' ELSE 'value' END AS reason
FROM v WHERE NOT sound OR NOT two OR id IS NULL OR NOT seen"""
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return strict_records.failed_records(table(spark, folder, "input_records"))


@query(RECORDS + "SELECT rec_id, id, name FROM v WHERE sound AND two AND id IS NOT NULL AND seen")
def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return strict_records.load_valid(table(spark, folder, "input_records"))


# Transforms ----------------------------------------------------------------------------------

#: All characters up to U+0020, as SQL.
SQL_TRIMMED = " || ".join(f"chr({i})" for i in range(1, 33))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, content) of documents.text as a pipeline's rows: null text is empty, as sources give it."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))


ROW = row_type([field("id", LONG), field("content", STRING)])


def chained(df: DataFrame, *transforms: Transform, schema: StructType = ROW) -> DataFrame:
    return Chain(list(transforms), schema)(df)


@query("SELECT doc_id, source, lang FROM documents")
def t1_select(spark: SparkSession, folder: str) -> DataFrame:
    schema = row_type([field("doc_id", LONG), field("lang", STRING), field("source", STRING)])
    return chained(table(spark, folder, "documents").select("doc_id", "lang", "source"), Transform("select", fields=["doc_id", "source", "lang"]), schema=schema)


@query("SELECT id, coalesce(content, '') AS text FROM articles")
def t2_rename(spark: SparkSession, folder: str) -> DataFrame:
    return chained(table(spark, folder, "articles").select("id", F.coalesce("content", F.lit("")).alias("content")), Transform("rename", source="content", target="text"))


@query(f"SELECT doc_id AS id, trim(coalesce(text, ''), {SQL_TRIMMED}) AS content FROM documents")
def t3_trim(spark: SparkSession, folder: str) -> DataFrame:
    return chained(texts(spark, folder), Transform("trim", field="content"))


# Final sigma: DuckDB writes σ everywhere, so both sides show one form of it.
@query("SELECT id, replace(lower(coalesce(content, '')), 'ς', 'σ') AS content FROM articles")
def t4_lowercase(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "articles").select("id", F.coalesce("content", F.lit("")).alias("content"))
    return chained(rows, Transform("lowercase", field="content"), Transform("replace", field="content", target="ς", replacement="σ"))


@query("SELECT doc_id AS id, replace(coalesce(text, ''), '. ', '; ') AS content FROM documents")
def t5_replace(spark: SparkSession, folder: str) -> DataFrame:
    return chained(texts(spark, folder), Transform("replace", field="content", target=". ", replacement="; "))


def sql_chunks(text: str, size: int, step: int) -> str:
    """SQL for (id, chunk, i, n) of all documents: windows of UTF-16 units of ``text``, n units long.

    Behind each supplementary character a mark (U+E000) stands for its second unit. A mark that
    opens a window, or a character without its mark at the end of one, is half a pair and shows as ``?``.
    """
    mark, wide = "\\x{e000}", "[\\x{10000}-\\x{10ffff}]"
    piece = f"substr(text, (i * {step} + 1)::BIGINT, {size})"
    shown = f"regexp_replace(regexp_replace({piece}, '^{mark}', '?'), '{wide}\\z', '?')"
    return f"""
WITH d AS (SELECT doc_id AS id, regexp_replace({text}, '({wide})', '\\1' || chr(57344), 'g') AS text FROM documents WHERE text IS NOT NULL),
e AS (SELECT id, text, length(text)::BIGINT AS n FROM d WHERE text <> ''),
k AS (SELECT *, unnest(range(0, CASE WHEN n <= {size} THEN 1 ELSE ceil((n - {size - step}) / {step}.0)::BIGINT END)) AS i FROM e),
c AS (SELECT id, replace({shown}, chr(57344), '') AS chunk, i::BIGINT AS i, n FROM k)
"""


CHUNK = Transform("chunk", input="content", output="chunk", chunk_size=500, overlap=50, drop_input=True, include_offsets=True)


@query(sql_chunks("text", 500, 450) + "SELECT id, chunk, i AS chunk_index, (i * 450)::BIGINT AS chunk_start, least(i * 450 + 500, n)::BIGINT AS chunk_end FROM c")
def t6_chunk(spark: SparkSession, folder: str) -> DataFrame:
    return chained(texts(spark, folder), CHUNK)


@query(sql_chunks("text", 7, 4) + "SELECT id, chunk, i AS chunk_index FROM c")
def t6_small_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Windows so small that many cut a pair of units in two."""
    return chained(texts(spark, folder), Transform("chunk", input="content", output="chunk", chunk_size=7, overlap=3, drop_input=True))


@query("""
WITH d AS (SELECT doc_id AS id, length(regexp_replace(coalesce(text, ''), '[\\x{10000}-\\x{10ffff}]', 'xx', 'g')) AS n FROM documents)
SELECT id, (n)::FLOAT AS v0, (n + 1)::FLOAT AS v1, (n + 2)::FLOAT AS v2, (n + 3)::FLOAT AS v3 FROM d
""")
def t7_mock_embedding(spark: SparkSession, folder: str) -> DataFrame:
    rows = chained(texts(spark, folder), Transform("mock-embedding", input="content", output="v", dimensions=4))
    return rows.select("id", *[F.col("v")[i].alias(f"v{i}") for i in range(4)])


@query("""
WITH d AS (SELECT doc_id AS id, length(regexp_replace(coalesce(text, ''), '[\\x{10000}-\\x{10ffff}]', 'xx', 'g')) AS n FROM documents)
SELECT id, n::FLOAT AS first, (n + 7)::FLOAT AS last FROM d
""")
def t8_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """The batched provider path, through Arrow: the mock provider as an external one."""
    embedding.register("local", lambda t: embedding.mock(8))
    rows = chained(texts(spark, folder), Transform("embedding", provider="local", input="content", output="v", batch_size=32))
    return rows.select("id", F.col("v")[0].alias("first"), F.col("v")[7].alias("last"))


CHAINED = f"trim(replace(lower(replace(coalesce(content, ''), 'x', '')), 'ς', 'σ'), {SQL_TRIMMED})"


@query(f"SELECT id, {CHAINED} AS body FROM articles WHERE {CHAINED} <> ''")
def t10_chain(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "articles").select("id", F.coalesce("content", F.lit("")).alias("content"))
    return chained(
        rows, Transform("replace", field="content", target="x"), Transform("lowercase", field="content"), Transform("replace", field="content", target="ς", replacement="σ"),
        Transform("trim", field="content"), Transform("filter", field="content", op="not-empty"), Transform("rename", source="content", target="body"),
    )


# Filters -------------------------------------------------------------------------------------


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(id, content) of every line of documents.text, with its number in its text."""
    split = texts(spark, folder).select("id", F.posexplode(F.split("content", "\n")).alias("line", "content"))
    return split.select("id", F.col("line").cast("bigint").alias("line"), "content")


SQL_LINES = "(SELECT id, line - 1 AS line, content[line] AS content FROM (SELECT id, content, unnest(range(1, len(content) + 1)) AS line FROM (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS content FROM documents)))"
LINE = row_type([field("id", LONG), field("line", LONG), field("content", STRING)])
UNITS = "length(regexp_replace({}, '[\\x{{10000}}-\\x{{10ffff}}]', 'xx', 'g'))"
PREDICATES = {
    "f1_not_empty": (dict(op="not-empty"), f"length(trim(content, {SQL_TRIMMED})) > 0"),
    "f2_min_length": (dict(op="min-length", min_length=80), UNITS.format(f"trim(content, {SQL_TRIMMED})") + " >= 80"),
    "f3_contains": (dict(op="contains", value="the"), "contains(content, 'the')"),
    "f4_starts_with": (dict(op="starts-with", value="#"), "starts_with(content, '#')"),
    "f5_ends_with": (dict(op="ends-with", value="."), "ends_with(content, '.')"),
    "f6_equals": (dict(op="equals", value=""), "content = ''"),
    "f7_not_equals": (dict(op="not-equals", value=""), "content <> ''"),
    "f8_greater_than": (dict(field="line", op="greater-than", value="3"), "line > 3"),
    "f9_greater_than_or_equal": (dict(field="line", op="greater-than-or-equal", value="3"), "line >= 3"),
    "f10_less_than": (dict(field="line", op="less-than", value="3"), "line < 3"),
    "f11_less_than_or_equal": (dict(field="line", op="less-than-or-equal", value="3"), "line <= 3"),
}


def _filter_query(settings: dict):  # noqa: ANN202
    step = Transform("filter", **({"field": "content"} | settings))
    return lambda spark, folder: chained(lines(spark, folder), step, schema=LINE)


for _name, (_settings, _condition) in PREDICATES.items():
    QUERIES[_name] = _filter_query(_settings)
    SQL[_name] = f"SELECT id, line::BIGINT AS line, content FROM {SQL_LINES} WHERE {_condition}"


# Sink rendering ------------------------------------------------------------------------------


@query("""
SELECT doc_id AS id, doc_id || ',' || CASE WHEN regexp_matches(coalesce(text, ''), '[,"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END AS line FROM documents
""")
def k2_csv_line(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).select("id", file.csv_line(ROW).alias("line"))


@query("SELECT vec_id AS id, '[' || array_to_string(list_transform(embedding, lambda v: printf('%.4f', v::DOUBLE)), ' ') || ']' AS cell FROM embeddings")
def k2_vector_cell(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows.select("id", file.csv_line(row_type([field("v", VECTOR)])).alias("cell"))


@query("""SELECT doc_id AS id, '{"id":' || doc_id || ',"content":' || to_json(coalesce(text, ''))::VARCHAR || '}' AS line FROM documents""")
def k3_json_line(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).select("id", file.json_line(ROW).alias("line"))


@query("""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
SELECT doc_id * 1000000 + i AS point_id, l[i + 1] AS content FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM d)
""")
def k7_point_ids(spark: SparkSession, folder: str) -> DataFrame:
    schema = row_type([field("id", LONG), field("line", LONG), field("content", STRING), field("v", VECTOR)])
    sink = vector.Qdrant(Sink("qdrant", url="", collection="c", id_field="id", vector_field="v", chunk_index_field="line", chunk_id_multiplier=1_000_000), schema, 0, print)
    return lines(spark, folder).select(sink.point_id().alias("point_id"), "content")


@query("""
WITH e AS (SELECT id, line, content FROM (SELECT id, line - 1 AS line, content[line] AS content FROM (SELECT id, content, unnest(range(1, len(content) + 1)) AS line FROM
     (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS content FROM documents))))
SELECT '[Row] id=' || id || ', line=' || line || ', content=' || content AS line FROM e
""")
def k1_console_line(spark: SparkSession, folder: str) -> DataFrame:
    sink = console.Console(Sink("console"), LINE, 0, print)
    return lines(spark, folder).select(sink.line().alias("line"))


# Dataflow control ----------------------------------------------------------------------------


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(_seq, _err) of the whole table of raw records: its rec_id counts the rows, what doesn't load is bad."""
    raw = table(spark, folder, "input_records").select(F.col("rec_id").alias(SEQ))
    bad = strict_records.failed_records(table(spark, folder, "input_records")).select(F.col("rec_id").alias(SEQ), F.col("reason").alias(ERR))
    return raw.join(bad, SEQ, "left")


@query("SELECT (rec_id - 1) // 500 AS split, min(rec_id) AS first, max(rec_id) AS last, count(*) AS rows FROM input_records GROUP BY 1")
def s14_splits(spark: SparkSession, folder: str) -> DataFrame:
    numbered = table(spark, folder, "input_records").withColumn("split", splits.split_number(F.col("rec_id"), 500))
    return numbered.groupBy("split").agg(F.min("rec_id").alias("first"), F.max("rec_id").alias("last"), F.count("*").alias("rows"))


def planned_splits(rows: DataFrame) -> list[splits.Split]:
    """Splits of 500 over all numbered rows."""
    return splits.plan("file", rows.agg(F.max("rec_id")).first()[0] or 0, 500)


@query("SELECT rec_id, line_no, 'file-part-' || ((rec_id - 1) // 500) AS split FROM input_records")
def s15_split_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of the table with the planned split that reads it."""
    rows = table(spark, folder, "input_records").select("rec_id", "line_no")
    planned = spark.createDataFrame([(k, s.id, s.start, s.end) for k, s in enumerate(planned_splits(rows))], "k bigint, split string, first bigint, last bigint")
    read = (splits.split_number(F.col("rec_id"), 500) == F.col("k")) & F.col("rec_id").between(F.col("first"), F.col("last"))
    return rows.join(planned, read).select("rec_id", "line_no", "split")


SQL_BATCHES = (
    RECORDS
    + """, s AS (SELECT rec_id, (rec_id - 1) // 500 AS split, NOT (sound AND two AND id IS NOT NULL AND seen) AS bad FROM v WHERE rec_id > 250),
p AS (SELECT *, sum(bad::INT) OVER (PARTITION BY split ORDER BY rec_id) AS part FROM s),
b AS (SELECT rec_id, split, part, bad, (row_number() OVER (PARTITION BY split, part, bad ORDER BY rec_id) - 1) // 7 AS no FROM p)
"""
)


@query(SQL_BATCHES + "SELECT rec_id, split::BIGINT AS split, part::BIGINT AS part, no::BIGINT AS no FROM b WHERE NOT bad")
def d1_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Flushes of 7 rows in splits of 500, behind a checkpoint at 250."""
    batched = splits.with_batches(records(spark, folder), 500, 7, after=250).where(F.col(ERR).isNull())
    return batched.select(F.col(SEQ).alias("rec_id"), F.col("_b_split").alias("split"), F.col("_b_part").alias("part"), F.col("_b_no").alias("no"))


@query(
    SQL_BATCHES
    + """SELECT count(*) FILTER (NOT bad) AS rows_read, count(*) FILTER (bad) AS rows_failed,
(SELECT count(*) FROM (SELECT DISTINCT split, part, no FROM b WHERE NOT bad)) AS batches, max(rec_id) AS checkpoint FROM b"""
)
def d6_counters(spark: SparkSession, folder: str) -> DataFrame:
    batched = splits.with_batches(records(spark, folder), 500, 7, after=250)
    flushes = batched.where(F.col(ERR).isNull()).groupBy(*BATCH).agg(F.count("*").alias("n"), F.max(SEQ).alias("last"), F.lit(0).alias("bad"))
    failed = batched.where(F.col(ERR).isNotNull()).groupBy(*BATCH).agg(F.lit(0).cast("bigint").alias("n"), F.max(SEQ).alias("last"), F.count("*").alias("bad"))
    both = flushes.unionByName(failed)
    return both.agg(F.sum("n").alias("rows_read"), F.sum("bad").alias("rows_failed"), F.count_if(F.col("n") > 0).alias("batches"), F.max("last").alias("checkpoint"))


@query("SELECT rec_id FROM input_records WHERE rec_id > 640")
def d4_resume(spark: SparkSession, folder: str) -> DataFrame:
    return splits.with_batches(records(spark, folder), 500, 7, after=640).select(F.col(SEQ).alias("rec_id"))


@query(RECORDS + ", bad AS (SELECT min(rec_id) AS first FROM v WHERE NOT (sound AND two AND id IS NOT NULL AND seen)) SELECT rec_id FROM v, bad WHERE rec_id < first")
def s18_fail_fast(spark: SparkSession, folder: str) -> DataFrame:
    """What a fail-fast run writes: the rows before the first bad record."""
    rows = records(spark, folder)
    first = rows.where(F.col(ERR).isNotNull()).agg(F.min(SEQ).alias("first"))
    return rows.join(F.broadcast(first), F.col(SEQ) < F.col("first")).select(F.col(SEQ).alias("rec_id"))  # one row is broadcast


@query("""
WITH x AS (SELECT DISTINCT event_id AS n FROM events WHERE event_type <> 'click'), i AS (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM x)
SELECT min(n) AS first, max(n) AS last, count(*) AS rows FROM i GROUP BY g
""")
def d9_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Gapless runs of event numbers, where the clicks are missing."""
    return splits.runs(table(spark, folder, "events").where("event_type <> 'click'"), "event_id")


@query("""
WITH s AS (SELECT (rec_id - 1) // 500 AS split, min(rec_id) AS first, max(rec_id) AS last FROM input_records GROUP BY 1), n AS (SELECT count(*) AS n FROM s)
SELECT split // ceil(n / least(n, 4.0))::BIGINT AS bundle, min(first) AS first, max(last) AS last, count(*) AS splits FROM s, n GROUP BY 1
""")
def x1_bundles(spark: SparkSession, folder: str) -> DataFrame:
    total = table(spark, folder, "input_records").agg(F.max("rec_id")).first()[0] or 0
    planned = splits.bundles(splits.plan("file", total, 500), 4)
    return spark.createDataFrame([(i, b[0].start, b[-1].end, len(b)) for i, b in enumerate(planned)], "bundle bigint, first bigint, last bigint, splits bigint")


TASK_STATE = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END"


@query(f"""
WITH t AS (SELECT o_custkey AS job_id, {TASK_STATE} AS state FROM orders)
SELECT job_id, CASE WHEN count(*) FILTER (state = 'RUNNING') > 0 THEN NULL WHEN count(*) FILTER (state = 'COMPLETED') = count(*) THEN 'COMPLETED'
WHEN count(*) FILTER (state = 'COMPLETED') > 0 THEN 'FINISHED_WITH_ERRORS' ELSE 'FAILED' END AS state, count(*) AS tasks FROM t GROUP BY 1
""")
def x4_job_states(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tasks of their customer's job."""
    return jobs.job_states(table(spark, folder, "orders").select(F.col("o_custkey").alias("job_id"), F.expr(TASK_STATE).alias("state")))


# Files, there and back ------------------------------------------------------------------------


def part_files(rows: DataFrame, line: Column, header: str | None) -> str:
    """Writes rows as the part files of a folder, in the order of ids, as pipelines read and write them; gives the folder."""
    folder = scratch(rows.sparkSession)
    ordered = rows.withColumn(SEQ, F.col("id")).withColumn(POSITION, F.lit(0))
    file.write_lines(ordered, line, folder, header, ordered=True)
    return folder


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").select("id", F.coalesce("content", F.lit("")).alias("content"))


@query("SELECT id, coalesce(content, '') AS content, row_number() OVER (ORDER BY id) AS seq, NULL::VARCHAR AS error FROM articles")
def s1_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as CSV files, read back by the strict source with numbers in the order of the files."""
    path = part_files(articles(spark, folder), file.csv_line(ROW), "id,content")
    return open_source(spark, Source("file", path, "csv")).df.select("id", "content", F.col(SEQ).alias("seq"), F.col(ERR).alias("error"))


@query("SELECT id, coalesce(content, '') AS content, row_number() OVER (ORDER BY id) AS seq, NULL::VARCHAR AS error FROM articles")
def s2_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    path = part_files(articles(spark, folder), file.json_line(ROW), None)
    return open_source(spark, Source("file", path, "jsonl")).df.select("id", "content", F.col(SEQ).alias("seq"), F.col(ERR).alias("error"))


@query("""
SELECT count(*) AS "rowsRead", count(*) FILTER (length(trim(content, chr(9) || chr(10) || chr(13) || ' ')) > 0) AS "rowsWritten", 0::BIGINT AS "rowsFailed", count(*) AS "checkpointSeq",
ceil(count(*) / 500.0)::BIGINT AS "sourceSplits" FROM articles
""")
def d2_run(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of a checkpointed run from files to files, flushes of 500 rows."""
    path = part_files(articles(spark, folder), file.json_line(ROW), None)
    steps = [Transform("filter", field="content", op="not-empty"), Transform("mock-embedding", input="content", output="v", batch_size=500)]
    with tempfile.TemporaryDirectory() as state:  # the driver's own record of the run
        pipeline = Pipeline("d2", Source("file", path, "jsonl", max_rows_per_split=500), steps, Sink("file", scratch(spark) + "/", "jsonl"), state)
        done = runner.run(spark, pipeline, lambda _: None)
    names = ["rowsRead", "rowsWritten", "rowsFailed", "checkpointSeq", "sourceSplits"]
    return spark.createDataFrame([tuple(getattr(done, n) for n in names)], ", ".join(f"{n} bigint" for n in names))


def copied(spark: SparkSession, source: Source, sink: Sink, steps: list[Transform] | None = None, state_dir: str | None = None, rows_per_commit: int | None = None) -> runner.Summary:
    return runner.run(spark, Pipeline("copy", source, steps or [], sink, state_dir), lambda _: None, rows_per_commit)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(seq, id, content) of what a pipeline has written as JSON lines."""
    return open_source(spark, Source("file", path, "jsonl")).df.select(F.col(SEQ).alias("seq"), "id", "content")


def driver_folder() -> str:
    """A folder of the driver's, for sinks that are one local file; it goes when the program ends."""
    out = tempfile.mkdtemp(prefix="loomline-")
    atexit.register(shutil.rmtree, out, True)
    return out


ARTICLES = "SELECT id, coalesce(content, '') AS content FROM articles"
SEQUENCED = "SELECT row_number() OVER (ORDER BY id) AS seq, id, coalesce(content, '') AS content FROM articles"


@query("SELECT row_number() OVER (ORDER BY doc_id) AS seq, doc_id AS id, coalesce(max(text), '') AS content FROM documents GROUP BY doc_id")
def s11_run(spark: SparkSession, folder: str) -> DataFrame:
    """A grouped query with a wide text, run through the engine into one file and read back with its numbers."""
    out = driver_folder()
    text = f"SELECT doc_id AS id, max(text) AS content FROM read_parquet('{folder}/documents.parquet') GROUP BY doc_id ORDER BY doc_id"
    copied(spark, Source("duckdb", query=text), Sink("file", f"{out}/all.jsonl", "jsonl"))
    return read_back(spark, f"{out}/all.jsonl")


@query(SEQUENCED)
def x2_job(spark: SparkSession, folder: str) -> DataFrame:
    """A job of four bundles side by side with one file for a sink, read back."""
    path = part_files(articles(spark, folder), file.json_line(ROW), None)
    out = driver_folder()
    pipeline = Pipeline("x2", Source("file", path, "jsonl", max_rows_per_split=200), [], Sink("file", f"{out}/all.jsonl", "jsonl"))
    tasks = jobs.Jobs(spark, f"{out}/state")
    job = tasks.submit(pipeline, 4)
    assert tasks.run(job, pipeline, 4) == state.COMPLETED
    return read_back(spark, f"{out}/all.jsonl")


class Refusing:
    """Refuses the flush with row 1 as often as it is told to, and forgets everything else."""

    times = 0

    def __init__(self, *_: object): ...
    def open(self) -> None: ...
    def close(self) -> None: ...

    def write(self, rows: list, last_seq: int) -> None:
        if rows[0][SEQ] == 1 and Refusing.times:
            Refusing.times -= 1
            raise RuntimeError("not now")


def refused(spark: SparkSession, folder: str, times: int) -> tuple[jobs.Jobs, str]:
    """A job of four bundles over all articles whose first bundle's sink fails so many times."""
    sinks.register("refusing", Refusing)
    Refusing.times = times
    path = part_files(articles(spark, folder), file.json_line(ROW), None)
    step = Transform("mock-embedding", input="content", output="v", batch_size=500)
    pipeline = Pipeline("refused", Source("file", path, "jsonl", max_rows_per_split=100), [step], Sink("refusing"))
    out = driver_folder()
    tasks = jobs.Jobs(spark, out)
    job = tasks.submit(pipeline, 4)
    tasks.run(job, pipeline, 4)
    return tasks, job


SQL_BUNDLES = """
WITH n AS (SELECT count(*) AS n, ceil(count(*) / 100.0)::BIGINT AS splits FROM articles), m AS (SELECT *, ceil(splits / least(splits, 4.0))::BIGINT AS size FROM n),
b AS (SELECT k, k * size * 100 + 1 AS first, least((k + 1) * size * 100, n) AS last FROM m, range(0, 4) r(k) WHERE k * size < splits)
"""


@query(SQL_BUNDLES + "SELECT first::BIGINT AS first, last::BIGINT AS last, CASE k WHEN 0 THEN 3 ELSE 1 END::BIGINT AS attempts, 'COMPLETED' AS state FROM b")
def x6_retries(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts of every task of a job whose first task fails twice."""
    tasks, job = refused(spark, folder, 2)
    return spark.createDataFrame([(t.start, t.end, t.attempt, t.state) for t in tasks.tasks(job)], "first bigint, last bigint, attempts bigint, state string")


@query(SQL_BUNDLES + "SELECT first::BIGINT AS first, last::BIGINT AS last, 4::BIGINT AS attempts, 'RETRY_EXHAUSTED' AS code, 'FINISHED_WITH_ERRORS' AS job FROM b WHERE k = 0")
def x3_failed_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The failed tasks of a job whose first task fails at every attempt."""
    tasks, job = refused(spark, folder, jobs.MOST_ATTEMPTS)
    return spark.createDataFrame([(t.start, t.end, t.attempt, t.error_code, tasks.status(job)) for t in tasks.failed(job)], "first bigint, last bigint, attempts bigint, code string, job string")


@query("SELECT row_number() OVER (ORDER BY 'doc=' || doc_id || '/') AS id, doc_id, coalesce(text, '') || chr(10) AS content FROM documents")
def s3_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as a document of its own, read back as a folder of documents, numbered by path."""
    root = scratch(spark).removeprefix("file://")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # Spark's own writer starts a process for the rights of each file
        for batch in batches:
            for doc, content in zip(*(c.to_pylist() for c in batch.columns)):
                os.makedirs(f"{root}/doc={doc}", exist_ok=True)
                with open(f"{root}/doc={doc}/text.txt", "wb") as f:
                    f.write(f"{content}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["written"])

    texts(spark, folder).mapInArrow(write, "written bigint").agg(F.sum("written")).first()
    rows = open_source(spark, Source("file", root, "document")).df
    return rows.select("id", F.regexp_extract("path", "^doc=([0-9]+)/", 1).cast("bigint").alias("doc_id"), "content")


@query("""
SELECT row_number() OVER (ORDER BY id) + 1 AS seq, CASE WHEN content IS NULL THEN 'Invalid JSONL row at line ' || (row_number() OVER (ORDER BY id) + 1) || ': field content must not be null'
WHEN content LIKE '{%' AND json_valid(content) THEN 'Invalid JSONL row at line ' || (row_number() OVER (ORDER BY id) + 1) || ': field content must be a scalar value' END AS error FROM articles
UNION ALL SELECT 1, NULL
""")
def s2_bad_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as JSON lines, contents that are JSON objects unquoted: null and nested values are bad records."""
    content = F.col("content")
    nested = content.startswith("{") & F.try_parse_json(content).isNotNull()
    value = F.when(content.isNull(), "null").when(nested, F.regexp_replace(content, r"[\r\n]", " ")).otherwise(F.regexp_replace(F.to_json(F.struct(content)), r'^\{"content":(.*)\}$', "$1"))
    rows = table(spark, folder, "articles").select("id", F.concat(F.lit('{"id":'), "id", F.lit(',"content":'), value, F.lit("}")).alias("line"))
    rows = rows.unionByName(spark.createDataFrame([(-(2**62), '{"id":0,"content":"sound"}')], "id bigint, line string"))
    path = part_files(rows, F.col("line"), None)
    return open_source(spark, Source("file", path, "jsonl")).df.select(F.col(SEQ).alias("seq"), F.col(ERR).alias("error"))


def database(spark: SparkSession, rows: DataFrame) -> str:
    """URL of a read-only Derby database with the table ``articles`` of these rows, in one file of the shared folder.

    A database in memory, or in a folder, belongs to the one JVM that opened it. One in an archive
    can be opened by the driver and by all executors at once. It holds pages as they are on disk,
    so that no process needs memory for the table, and the index gives the rows in order. Ids may
    be missing or there more than once. A shared folder that is no local path can't hold it: it is
    then in a folder of the driver's machine.
    """
    out = driver_folder()
    fs, shared = file_system(spark, scratch(spark))
    to = shared.toUri().getPath() if fs.getScheme() == "file" else f"{out}/packed"
    os.makedirs(to)
    atexit.register(shutil.rmtree, to, True)
    content = F.concat(F.lit('"'), F.replace("content", F.lit('"'), F.lit('""')), F.lit('"'))  # without quotes an empty text would be null
    line = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(","), content)
    parts, driver = part_files(rows, line, None), spark.sparkContext._jvm.org.apache.derby.jdbc.EmbeddedDriver()
    with open(f"{out}/rows.csv", "wb") as f:
        file.join_parts(spark, [parts], f)
    delete(spark, parts)
    connect = lambda url: driver.connect(f"jdbc:derby:{url}", spark.sparkContext._jvm.java.util.Properties())
    connection = connect(f"{out}/made;create=true")
    for text in (
        'CREATE TABLE articles ("id" BIGINT, "content" CLOB)',
        f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'ARTICLES', '{out}/rows.csv', ',', '\"', 'UTF-8', 1)",
        'CREATE INDEX by_id ON articles ("id")',
    ):
        connection.createStatement().execute(text)
    connection.close()
    try:
        connect(f"{out}/made;shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # what Derby says of a database that it has closed
            raise
    os.remove(f"{out}/rows.csv")
    with zipfile.ZipFile(f"{to}/made.jar", "w", zipfile.ZIP_STORED) as packed:  # not compressed: pages are read at their places
        for at, _, names in os.walk(f"{out}/made"):
            for name in names:
                packed.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), out))
    shutil.rmtree(f"{out}/made")
    return f"jdbc:derby:jar:({to}/made.jar)made"


def jdbc_articles(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Articles in a database that all processes can open, read by the source for databases of this kind."""
    url = database(spark, articles(spark, folder))
    os.environ.setdefault("LOOMLINE_JDBC", "APP")
    query = 'SELECT "id", "content", CAST("id" AS DECIMAL(21, 2)) AS "wide" FROM articles --DERBY-PROPERTIES index=by_id\n ORDER BY "id"'
    source = Source(kind, url=url, query=query, user_env="LOOMLINE_JDBC", password_env="LOOMLINE_JDBC", options={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    wide = F.when(F.col(ERR).isNull(), F.col("wide")).alias("wide")  # a row without an id is a bad record
    return open_source(spark, source).df.select(F.col(SEQ).alias("seq"), "id", "content", wide)


JDBC = "SELECT row_number() OVER (ORDER BY id) AS seq, id, coalesce(content, '') AS content, id || '.00' AS wide FROM articles"


@query(JDBC)
def s9_postgres(spark: SparkSession, folder: str) -> DataFrame:
    return jdbc_articles(spark, folder, "postgres")


@query(JDBC)
def s10_mysql(spark: SparkSession, folder: str) -> DataFrame:
    return jdbc_articles(spark, folder, "mysql")


@query(f"SELECT id, content, 2::BIGINT AS copies FROM ({ARTICLES})")
def k4_append(spark: SparkSession, folder: str) -> DataFrame:
    """The same pipeline twice with a folder in append mode: every row is there twice."""
    path, out = part_files(articles(spark, folder), file.json_line(ROW), None), scratch(spark)
    for _ in range(2):
        copied(spark, Source("file", path, "jsonl"), Sink("file", f"{out}/", "jsonl", "append"))
    return read_back(spark, out).groupBy("id", "content").agg(F.count("*").alias("copies"))


@query(SEQUENCED)
def k5_resume(spark: SparkSession, folder: str) -> DataFrame:
    """A run into one file whose state is set back behind row 700 and that runs again: every row once, in order."""
    path = part_files(articles(spark, folder), file.json_line(ROW), None)
    out = driver_folder()
    go = lambda: copied(spark, Source("file", path, "jsonl", max_rows_per_split=100), Sink("file", f"{out}/all.jsonl", "jsonl"), state_dir=f"{out}/state", rows_per_commit=500)
    go()
    state.Store(f"{out}/state").put("local-pipeline-copy", state.Task("local-pipeline-copy", state=state.RUNNING, attempt=1, checkpoint=700))
    go()
    return read_back(spark, f"{out}/all.jsonl")


@query("SELECT '[AI Sink] Row ID: ' || vec_id || ', Vector Dim: ' || len(embedding) || ', First Val: ' || printf('%.4f', embedding[1]::DOUBLE) AS line FROM embeddings")
def k6_mock_vector_line(spark: SparkSession, folder: str) -> DataFrame:
    sink = console.MockVector(Sink("mock-vector"), row_type([field("id", LONG), field("embedding", VECTOR)]), 0, print)
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding").select(sink.line().alias("line"))


@contextmanager
def listening(spark: SparkSession, answer: str):  # noqa: ANN201
    """A stand-in for a vector store on the driver: (url, bodies of the requests it got)."""
    bodies: list[dict] = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            bodies.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer.encode())

        do_PUT = do_POST

        def log_message(self, *_: object) -> None: ...

    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    server = ThreadingHTTPServer((host, 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://{host}:{server.server_port}", bodies
    finally:
        server.shutdown()


EMBEDDED = "SELECT id, content, length(regexp_replace(content, '[\\x{10000}-\\x{10ffff}]', 'xx', 'g'))::DOUBLE AS first FROM (" + ARTICLES + ")"
STORED = "id bigint, content string, first double"


def embedded(spark: SparkSession, folder: str, sink: Sink) -> None:
    path = part_files(articles(spark, folder), file.json_line(ROW), None)
    copied(spark, Source("file", path, "jsonl"), sink, [Transform("mock-embedding", input="content", output="v", batch_size=64)])


@query(EMBEDDED)
def k7_qdrant(spark: SparkSession, folder: str) -> DataFrame:
    """Points that a store is sent by a run over all articles."""
    with listening(spark, '{"status":"ok"}') as (url, bodies):
        embedded(spark, folder, Sink("qdrant", url=url, collection="c", id_field="id", vector_field="v"))
    points = {p["id"]: (p["id"], p["payload"]["content"], p["vector"][0]) for b in bodies for p in b["points"]}  # an upsert by id
    return spark.createDataFrame(list(points.values()), STORED)


@query(EMBEDDED)
def k9_milvus(spark: SparkSession, folder: str) -> DataFrame:
    with listening(spark, '{"code":0}') as (url, bodies):
        embedded(spark, folder, Sink("milvus", url=url, collection="c", id_field="id", vector_field="v"))
    rows = {d["id"]: (d["id"], d["content"], d["v"][0]) for b in bodies for d in b["data"]}
    return spark.createDataFrame(list(rows.values()), STORED)


class _Sqlite:
    """A DB-API connection to a database file that all tasks of one machine share."""

    def __init__(self, url: str, *_: object):
        self.db = sqlite3.connect(url, timeout=60)
        self.commit, self.close = self.db.commit, self.db.close

    def cursor(self) -> _Sqlite:
        return self

    def executemany(self, sql: str, values: list) -> None:
        self.db.executemany(sql.replace("?::vector", "?"), values)


@query(EMBEDDED)
def k8_pgvector(spark: SparkSession, folder: str) -> DataFrame:
    """Upserts of a run over all articles, made twice, into a table of a local database (local masters only)."""
    with tempfile.TemporaryDirectory() as out:
        url = f"{out}/vectors.db"
        with sqlite3.connect(url) as db:
            db.execute("CREATE TABLE vectors (id INTEGER PRIMARY KEY, v TEXT, content TEXT)")
        os.environ.setdefault("LOOMLINE_JDBC", "APP")
        connect, vector.Pgvector.connect = vector.Pgvector.connect, _Sqlite
        try:
            for _ in range(2):
                embedded(spark, folder, Sink("pgvector", url=url, table="vectors", id_field="id", vector_field="v", user_env="LOOMLINE_JDBC", password_env="LOOMLINE_JDBC"))
        finally:
            vector.Pgvector.connect = connect
        rows = [(i, c, json.loads(v)[0]) for i, v, c in sqlite3.connect(url).execute("SELECT id, v, content FROM vectors")]
    return spark.createDataFrame(rows, STORED)


@query('SELECT 0::BIGINT AS "rowsRead", 0::BIGINT AS "rowsWritten", count(*) AS "rowsSkipped", count(*) AS "checkpointSeq", \'COMPLETED\' AS state FROM articles')
def d5_completed_rerun(spark: SparkSession, folder: str) -> DataFrame:
    """What the second run of a completed pipeline does: nothing."""
    path, out = part_files(articles(spark, folder), file.json_line(ROW), None), scratch(spark)
    with tempfile.TemporaryDirectory() as folder_of_state:
        done = [copied(spark, Source("file", path, "jsonl"), Sink("file", f"{out}/", "jsonl"), state_dir=folder_of_state) for _ in range(2)][1]
        found = state.Store(folder_of_state).get("local-pipeline-copy").state
    return spark.createDataFrame([(done.rowsRead, done.rowsWritten, done.rowsSkipped, done.checkpointSeq, found)], '`rowsRead` bigint, `rowsWritten` bigint, `rowsSkipped` bigint, `checkpointSeq` bigint, state string')


@query("""
WITH n AS (SELECT row_number() OVER (ORDER BY id) AS k, content FROM articles), f AS (SELECT min(k) AS k FROM n WHERE content IS NULL)
SELECT 'Source stage failed: Invalid JSONL row at line ' || (k + 1) || ': field content must not be null' AS error, k::BIGINT AS written, k::BIGINT AS checkpoint FROM f WHERE k IS NOT NULL
""")
def d7_stage_error(spark: SparkSession, folder: str) -> DataFrame:
    """A fail-fast run over articles with null contents: its error, the rows before it, and the checkpoint it leaves."""
    line = F.to_json(F.struct("id", "content"), {"ignoreNullFields": "false"})
    rows = table(spark, folder, "articles").select("id", "content").unionByName(spark.createDataFrame([(-(2**62), "sound")], "id bigint, content string"))
    path, out = part_files(rows, line, None), scratch(spark)
    found = []
    with tempfile.TemporaryDirectory() as folder_of_state:
        try:
            copied(spark, Source("file", path, "jsonl"), Sink("file", f"{out}/", "jsonl"), state_dir=folder_of_state)
        except StageError as e:
            kept = state.Store(folder_of_state).get("local-pipeline-copy").checkpoint
            found.append((str(e), read_back(spark, out).count(), kept))
    return spark.createDataFrame(found, "error string, written bigint, checkpoint bigint")


@query("SELECT 'duckdb-0' AS split, 1::BIGINT AS first, count(*) AS rows FROM orders WHERE o_totalprice > 100000")
def s16_single_split(spark: SparkSession, folder: str) -> DataFrame:
    """The one split of a SQL source, with the rows that it reads."""
    rows = open_source(spark, Source("duckdb", query=f"SELECT o_orderkey AS id FROM read_parquet('{folder}/orders.parquet') WHERE o_totalprice > 100000"))
    split = splits.plan(rows.split_prefix, rows.df.count(), rows.rows_per_split)[0]
    return rows.between(split.start, split.end).agg(F.lit(split.id).alias("split"), F.min(SEQ).alias("first"), F.count("*").alias("rows"))


def registered_articles(spark: SparkSession, source: Source) -> Rows:
    """A registered source: numbered once, as the built-in ones are."""
    rows = spark.read.parquet(f"{source.options['folder']}/articles.parquet").select("id", F.coalesce("content", F.lit("")).alias("content")).orderBy("id")
    return Rows(lambda: Numbered(materialize(placed(rows).select(PIECE, PLACE, "id", "content"))), ROW, "mine", 400, lambda df: df.select(SEQ, F.lit(None).cast("string").alias(ERR), "id", "content"))


@query(SEQUENCED)
def s17_registered(spark: SparkSession, folder: str) -> DataFrame:
    """A pipeline from a registered source into a registered parallel sink: its rows with their numbers."""
    register_source("mine", registered_articles)
    kept: list[str] = []

    class Kept:
        def open(self) -> None: ...
        def close(self) -> None: ...

        def write_table(self, df: DataFrame, batch_rows: int, first: int = 1) -> int:
            kept.append(f"{shared_dir(spark)}/loomline-{uuid.uuid4().hex}")  # outlives the run
            df.select(F.col(SEQ).alias("seq"), "id", "content").write.parquet(kept[-1])
            return spark.read.parquet(kept[-1]).count()

    sinks.register("keeping", lambda *_: Kept())
    copied(spark, Source("mine", options={"folder": folder}), Sink("keeping"))
    return spark.read.parquet(*kept)


@query("SELECT '[Row] id=' || id || ', content=' || coalesce(content, '') AS line, row_number() OVER (ORDER BY id) AS place FROM articles")
def k1_console(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that a run shows on the console, in their order."""
    path, shown = part_files(articles(spark, folder), file.json_line(ROW), None), []
    runner.run(spark, Pipeline("k1", Source("file", path, "jsonl"), [], Sink("console")), shown.append)
    return spark.createDataFrame([(line, i) for i, line in enumerate((x for x in shown if x.startswith("[Row]")), 1)], "line string, place bigint")


FILE_PIPELINE = """name: checked
source:
  type: file
  format: jsonl
  path: {path}
transforms:
  - type: chunk
    input: content
    output: chunk
    chunkSize: 500
    overlap: 50
sink:
  type: {sink}
"""


@query("SELECT * FROM (VALUES (1, 'Pipeline valid: checked'), (2, 'Source: file fields=2'), (3, 'Transforms: 1'), (4, 'Sink: console'), (5, 'Transform stage failed: Unknown transform field: nothing'), (6, 'Unsupported sink.type: nowhere')) t(place, line)")
def d8_validate(spark: SparkSession, folder: str) -> DataFrame:
    """What checking pipeline files says: a good one, one with an unknown field, one with an unknown sink."""
    path = part_files(articles(spark, folder), file.json_line(ROW), None)
    good = FILE_PIPELINE.format(path=path, sink="console")
    lines = runner.validate(spark, config.loads(good))
    for text in (good.replace("input: content", "input: nothing"), good.replace("console", "nowhere")):
        try:
            lines += runner.validate(spark, config.loads(text))
        except (ConfigError, StageError) as e:
            lines.append(str(e))
    return spark.createDataFrame(list(enumerate(lines, 1)), "place int, line string")


LEASED = "CASE c_custkey % 5 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'RETRYING' ELSE 'DISPATCHING' END"


@query(f"WITH t AS (SELECT 'task-' || c_custkey AS task, {LEASED} AS state, c_custkey % 7 AS lease FROM customer) SELECT task, row_number() OVER (ORDER BY task) AS place FROM t WHERE state IN ('CREATED', 'RETRYING') OR state IN ('RUNNING', 'DISPATCHING') AND lease <= 3")
def x8_schedulable(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as tasks of a store, leased for a while: those to be run at time 3, in their order."""
    rows = table(spark, folder, "customer").select("c_custkey", F.expr(LEASED).alias("state"), (F.col("c_custkey") % 7).alias("lease")).toLocalIterator()  # a table of tasks is the driver's
    tasks = [state.Task(f"task-{r[0]}", "job", r[1], lease_until=r[2]) for r in rows]
    found = [t.task_id for t in jobs.schedulable(tasks, jobs.expired(tasks, 3))]
    return spark.createDataFrame(list(enumerate(found, 1)), "place bigint, task string")


@query("SELECT n_nationkey AS key, 3::BIGINT AS version, n_nationkey * 10 AS checkpoint, 1::BIGINT AS refused FROM nation")
def x10_state_store(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a store after three versions each, one of which a second writer was refused."""
    store, rows = state.Store(driver_folder()), []
    for r in table(spark, folder, "nation").select("n_nationkey").toLocalIterator():
        key, refused = f"nation-{r[0]}", 0
        store.put(key, state.Task(key), -1)
        for i in range(3):
            found = store.get(key)
            store.put(key, found.to(state.RUNNING, checkpoint=r[0] * 10), found.version)
        try:
            store.put(key, found.to(state.RUNNING), found.version)
        except PipelineError:
            refused = 1
        last = store.get(key)
        rows.append((r[0], last.version, last.checkpoint, refused))
    return spark.createDataFrame(rows, "key bigint, version bigint, checkpoint bigint, refused bigint")


# Whole pipelines and SQL pass-through --------------------------------------------------------


@query("SELECT ('User-' || i) AS name, i AS id FROM (SELECT unnest(range(1, 11)) AS i)")
def s13_demo_rows(spark: SparkSession, folder: str) -> DataFrame:
    return demo.users(spark)


def passed_through(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """The rows of a SQL source over the folder's files, as a pipeline gets them (numbers and text)."""
    rows = open_source(spark, Source("duckdb", query=text.replace("{d}", folder)))
    return rows.df.drop(SEQ, ERR)


def _sql_query(name: str, text: str) -> None:
    """Registers a query that is SQL over files on both sides."""
    QUERIES[name] = lambda spark, folder: passed_through(spark, folder, text)
    SQL[name] = re.sub(r"read_parquet\('\{d\}/(\w+)\.parquet'\)", r"\1", text)


P = "read_parquet('{{d}}/{}.parquet')".format
_sql_query("s11_join", f"""
SELECT c_mktsegment AS segment, count(*) AS orders, count(DISTINCT o_custkey) AS customers, max(n_name) AS nation
FROM {P('orders')} JOIN {P('customer')} ON o_custkey = c_custkey JOIN {P('nation')} ON c_nationkey = n_nationkey GROUP BY c_mktsegment""")  # fmt: skip
_sql_query("s11_left_join", f"""
SELECT s_suppkey, count(l_orderkey) AS lines, coalesce(min(l_returnflag), '') AS flag FROM {P('supplier')} LEFT JOIN {P('lineitem')} ON s_suppkey = l_suppkey AND l_quantity > 45 GROUP BY s_suppkey""")  # fmt: skip
_sql_query("s11_semi_anti", f"""
SELECT c_custkey, c_name FROM {P('customer')} c WHERE EXISTS (SELECT 1 FROM {P('orders')} o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')
AND NOT EXISTS (SELECT 1 FROM {P('orders')} o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')""")  # fmt: skip
_sql_query("s11_window", f"""
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place,
coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS before FROM {P('events')}""")  # fmt: skip
_sql_query("s11_rollup", f"""
SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM {P('lineitem')} GROUP BY ROLLUP (l_returnflag, l_linestatus)""")  # fmt: skip
_sql_query("s11_set_operations", f"""
SELECT n_regionkey AS k FROM {P('nation')} INTERSECT SELECT r_regionkey FROM {P('region')} EXCEPT SELECT 2""")  # fmt: skip
_sql_query("s11_top_k", f"SELECT o_orderkey, o_custkey FROM {P('orders')} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_sql_query("s11_subquery", f"""
WITH spent AS (SELECT o_custkey AS k, count(*) AS n FROM {P('orders')} GROUP BY o_custkey)
SELECT k, n FROM spent WHERE n > (SELECT avg(n) FROM spent)""")  # fmt: skip


_sql_query("s11_full_join", f"""
SELECT coalesce(c_custkey, -1) AS customer, coalesce(o_orderkey, -1) AS ordered FROM (SELECT * FROM {P('customer')} WHERE c_custkey < 500) c
FULL JOIN (SELECT * FROM {P('orders')} WHERE o_custkey > 400) o ON c_custkey = o_custkey""")  # fmt: skip
_sql_query("s11_range_join", f"""
SELECT r_regionkey AS band, count(*) AS orders FROM {P('orders')} JOIN {P('region')} ON o_totalprice >= r_regionkey * 60000 AND o_totalprice < (r_regionkey + 1) * 60000 GROUP BY r_regionkey""")  # fmt: skip
_sql_query("s11_theta_join", f"""
SELECT a.n_nationkey AS k, count(*) AS later FROM {P('nation')} a JOIN {P('nation')} b ON a.n_name < b.n_name GROUP BY a.n_nationkey""")  # fmt: skip
_sql_query("s11_lateral", f"""
SELECT c_custkey, t.k AS last_order FROM {P('customer')}, LATERAL (SELECT max(o_orderkey) AS k FROM {P('orders')} WHERE o_custkey = c_custkey) t WHERE t.k IS NOT NULL""")  # fmt: skip
_sql_query("s11_interval_join", f"""
SELECT l_orderkey, l_linenumber, o_custkey FROM {P('lineitem')} JOIN {P('orders')} ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY""")  # fmt: skip
_sql_query("s11_cube", f"""
SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, grouping(l_returnflag) AS g, count(*) AS n FROM {P('lineitem')} GROUP BY CUBE (l_returnflag, l_linestatus)""")  # fmt: skip
_sql_query("s11_grouping_sets", f"""
SELECT coalesce(c_mktsegment, '*') AS segment, coalesce(c_nationkey, -1) AS nation, count(*) AS n FROM {P('customer')} GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""")  # fmt: skip
_sql_query("s11_unions", f"""
SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM {P('orders')} UNION ALL SELECT c_custkey FROM {P('customer')} UNION ALL (SELECT n_nationkey FROM {P('nation')} UNION SELECT r_regionkey FROM {P('region')})) GROUP BY k""")  # fmt: skip
_sql_query("s11_bag_operations", f"""
SELECT o_custkey AS k FROM {P('orders')} EXCEPT ALL SELECT c_custkey FROM {P('customer')} INTERSECT ALL SELECT o_custkey FROM {P('orders')}""")  # fmt: skip
_sql_query("s11_dates", f"""
SELECT event_id, year(ts) AS y, month(ts) AS m, dayofmonth(ts) AS d, hour(ts) AS h, cast(cast(date_trunc('month', ts) AS DATE) AS VARCHAR(10)) AS first, CASE WHEN last_day(cast(ts AS DATE)) = cast(ts AS DATE) THEN 1 ELSE 0 END AS ends,
datediff('day', DATE '2020-01-01', cast(ts AS DATE)) AS days FROM {P('events')}""")  # fmt: skip
_sql_query("s11_numbers", f"""
SELECT event_id, cast(floor(abs(value)) AS BIGINT) AS low, cast(ceil(value) AS BIGINT) AS high, cast(sign(value) AS BIGINT) AS s, event_id % 7 AS r, event_id // 7 AS q, event_id::VARCHAR AS t,
cast(round(sqrt(abs(value)) * 1000) AS BIGINT) AS root, greatest(event_id, user_id) AS g FROM {P('events')}""")  # fmt: skip
_sql_query("s11_distinct_on_keys", f"""
SELECT user_id, count(DISTINCT event_type) AS kinds, arg_max(event_id, event_id) AS last, min(event_type) FILTER (WHERE event_id % 2 = 0) AS least FROM {P('events')} GROUP BY user_id HAVING count(*) > 1""")  # fmt: skip
_sql_query("s11_running", f"""
SELECT event_id, cast(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three, ntile(4) OVER (ORDER BY event_id) AS quarter,
dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS kind, coalesce(lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS two_on FROM {P('events')}""")  # fmt: skip
_sql_query("s11_view", f"""
WITH RECURSIVE k(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM k WHERE n < 25), named AS (SELECT n, n_name FROM k JOIN {P('nation')} ON n_nationkey = n - 1)
SELECT n, n_name, '-- no comment, read_parquet(''x'') // 2' AS note FROM named WHERE n NOT IN (SELECT r_regionkey FROM {P('region')})""")  # fmt: skip


@query("""
SELECT vec_id, len(embedding) AS n, list_contains(embedding, embedding[1])::INT AS has, list_position(embedding, list_max(embedding)) AS at,
(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 2 ELSE -1 END)))::BIGINT AS total, len(list_filter(embedding, lambda x: x > 0)) AS above FROM embeddings
""")
def s11_arrays(spark: SparkSession, folder: str) -> DataFrame:
    return passed_through(spark, folder, """
        SELECT vec_id, array_size(embedding) AS n, cast(list_contains(embedding, embedding[0]) AS INT) AS has, array_position(embedding, list_max(embedding)) AS at,
        aggregate(transform(embedding, x -> CASE WHEN x > 0 THEN 2L ELSE -1L END), 0L, (a, x) -> a + x) AS total, array_size(filter(embedding, x -> x > 0)) AS above FROM read_parquet('{d}/embeddings.parquet')""")  # fmt: skip


@query("""
SELECT event_type AS kind, count(*) AS n, map_extract(map([event_type], [count(*)]), event_type)[1]::BIGINT AS in_map, json_extract_string(to_json({'k': event_type}), '$.k') AS in_json FROM events GROUP BY event_type
""")
def s11_maps_and_json(spark: SparkSession, folder: str) -> DataFrame:
    return passed_through(spark, folder, """
        SELECT event_type AS kind, count(*) AS n, try_element_at(map(event_type, count(*)), event_type) AS in_map, json_extract_string(to_json(named_struct('k', event_type)), '$.k') AS in_json
        FROM read_parquet('{d}/events.parquet') GROUP BY event_type""")  # fmt: skip


@query("""
SELECT event_id, coalesce(o_orderkey, -1) AS ordered FROM (SELECT event_id, user_id, ts FROM events) e
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON user_id = o_custkey AND ts >= o_orderdate
""")
def s11_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The latest order before each event, as one window over both tables; no pairs are made."""
    return passed_through(spark, folder, """
        SELECT n AS event_id, coalesce(ordered, -1) AS ordered FROM (
          SELECT n, last_value(k, true) OVER (PARTITION BY who ORDER BY at, is_event, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ordered, is_event FROM (
            SELECT user_id AS who, cast(ts AS TIMESTAMP) AS at, 1 AS is_event, cast(NULL AS BIGINT) AS k, event_id AS n FROM read_parquet('{d}/events.parquet')
            UNION ALL SELECT o_custkey, cast(o_orderdate AS TIMESTAMP), 0, o_orderkey, NULL FROM read_parquet('{d}/orders.parquet')))
        WHERE is_event = 1""")  # fmt: skip


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS rows FROM events GROUP BY 1, 2")
def g1_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each hour and kind, by the aggregation that streams of events go through."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed_counts(events, "ts", ["event_type"], "1 hour", "10 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS rows FROM s GROUP BY user_id, k
""")
def g2_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user, ended by two hours without an event."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.session_counts(events, "ts", ["user_id"], "2 hours", "10 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"SELECT doc_id AS id, {UNITS.format('coalesce(text, {q}{q})'.format(q=chr(39)))} AS units, trim(coalesce(text, ''), {SQL_TRIMMED}) AS bare FROM documents")
def u1_sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The engine's own string functions, called from a SQL source."""
    return passed_through(spark, folder, "SELECT doc_id AS id, utf16_length(coalesce(text, '')) AS units, trim_controls(coalesce(text, '')) AS bare FROM read_parquet('{d}/documents.parquet')")


@query(sql_chunks(f"trim(text, {SQL_TRIMMED})", 500, 450) + f"SELECT id, chunk, i AS chunk_index, {UNITS.format('chunk')}::FLOAT AS first FROM c")
def q_flagship(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder).select("id", "chunk", "chunk_index", F.col("embedding")[0].alias("first"))


def _flagship(rows: DataFrame) -> DataFrame:
    return chained(
        rows, Transform("trim", field="content"), Transform("filter", field="content", op="not-empty"),
        Transform("chunk", input="content", output="chunk", chunk_size=500, overlap=50, drop_input=True), Transform("mock-embedding", input="chunk", output="embedding"),
    )


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, trimmed, without the empty ones, in overlapping chunks with vectors: one narrow native plan."""
    return _flagship(texts(spark, folder))
