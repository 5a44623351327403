"""SQL over files: the query is Spark SQL, with table functions for files made tables.

This is where joins, aggregates, windows, set operations and subqueries enter a pipeline: the
query is planned by Catalyst together with the transforms behind it.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from loomline.config import Source
from loomline.errors import PipelineError
from loomline.functions import strings
from loomline.sources import Rows
from loomline.sources.jdbc import first_line, typed

#: Table functions that read files, and the reader each one is.
READERS = {
    "read_csv_auto": lambda spark, p: spark.read.csv(p, header=True, inferSchema=True, multiLine=True, escape='"'),
    "read_csv": lambda spark, p: spark.read.csv(p, header=True, inferSchema=True, multiLine=True, escape='"'),
    "read_json_auto": lambda spark, p: spark.read.json(p),
    "read_json": lambda spark, p: spark.read.json(p),
    "read_ndjson_auto": lambda spark, p: spark.read.json(p),
    "read_parquet": lambda spark, p: spark.read.parquet(p),
    "parquet_scan": lambda spark, p: spark.read.parquet(p),
}
#: Quoted text and comments, which stay as they are, and what is looked at between them.
LITERAL = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/"
CALL = r"(?<![\w.])(?P<reader>" + "|".join(READERS) + r")\s*\(\s*'(?P<path>(?:[^']|'')*)'\s*(?:,[^()]*)?\)"
BARE = r"\b(?P<word>from|join)\s+'(?P<file>(?:[^']|'')+\.(?P<suffix>parquet|csv|json|jsonl))'"
#: Names of another dialect's functions and operators, and what they are here.
SPELLINGS = {
    "list_contains": "array_contains", "list_distinct": "array_distinct", "list_sort": "array_sort", "list_concat": "concat", "list_min": "array_min", "list_max": "array_max",
    "array_length": "array_size", "list_value": "array", "json_extract_string": "get_json_object", "epoch": "unix_timestamp", "strlen": "octet_length", "string_agg": "listagg",
    "list": "collect_list", "arg_max": "max_by", "arg_min": "min_by", "regexp_matches": "regexp_like",
}
# Names of types.
TYPES = {"varchar": "string", "text": "string", "hugeint": "decimal(38,0)", "blob": "binary"}
OTHER = r"(?<![\w.])(?P<name>" + "|".join(SPELLINGS) + r")(?=\s*\()|(?P<quotient>//)|(?P<between>\bdate_?diff\s*\(\s*)'(?P<unit>[a-z]+)'|(?<=as |.::)(?P<type>" + "|".join(TYPES) + r")\b(?!\s*\()"
TOKEN = re.compile("|".join((CALL, BARE, LITERAL, OTHER)), re.I | re.S)


def to_spark(spark: SparkSession, query: str) -> str:
    """The query with each file function, or quoted file name, replaced by a temporary view of that file.

    Names in the table of spellings are written as Spark knows them. Text in quotes and comments stays.
    """
    views: dict[tuple[str, str], str] = {}
    by_suffix = {"parquet": "read_parquet", "csv": "read_csv_auto", "json": "read_json_auto", "jsonl": "read_json_auto"}

    def view(reader: str, path: str) -> str:
        key = (reader.lower(), path.replace("''", "'"))
        if key not in views:
            views[key] = f"_file_{len(views)}_{abs(hash(key)) % 10**8}"
            READERS[key[0]](spark, key[1]).createOrReplaceTempView(views[key])
        return views[key]

    def written(m: re.Match) -> str:
        if m["reader"]:
            return view(m["reader"], m["path"])
        if m["file"]:
            return f"{m['word']} {view(by_suffix[m['suffix'].lower()], m['file'])}"
        if m["unit"]:
            return f"datediff({m['unit']}"
        if m["type"]:
            return TYPES[m["type"].lower()]
        return SPELLINGS[m["name"].lower()] if m["name"] else " div " if m["quotient"] else m[0]

    return TOKEN.sub(written, query)


def read(spark: SparkSession, source: Source) -> Rows:
    try:
        strings.register(spark)
        return typed(spark.sql(to_spark(spark, source.query.strip().rstrip(";"))), "DuckDB", "duckdb")
    except PipelineError:
        raise
    except Exception as e:
        raise PipelineError(f"DuckDB source query failed: {first_line(e)}") from None
