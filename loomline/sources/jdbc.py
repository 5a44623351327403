"""Queries on Postgres and MySQL, read by Spark's JDBC source as one split in result order."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType

from loomline.config import Source
from loomline.errors import PipelineError, StageError
from loomline.functions.strings import col
from loomline.plans.lineage import materialize
from loomline.schema import ERR, LONG, PIECE, PLACE, SEQ, STRING, field, row_type
from loomline.sources import Numbered, Rows, placed

LABELS = {"postgres": "Postgres", "mysql": "MySQL", "duckdb": "DuckDB"}
DRIVERS = {"postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}


def credential(label: str, name: str) -> str:
    value = os.environ.get(name)
    if value is None:
        raise PipelineError(f"Missing {label} environment variable: {name}")
    return value


def typed(df: DataFrame, label: str, prefix: str) -> Rows:
    """Whole numbers become LONG, all else STRING; a null text is empty, a null number a bad record.

    The query runs once: its result is written to the shared folder in the result's order, and
    rows are numbered there. Running it again could give other partitions, and with them other numbers.
    """
    whole = lambda t: isinstance(t, (LongType, IntegerType, ShortType, ByteType))
    kinds: list[tuple[str, DataType]] = [(f.name, LONG if whole(f.dataType) else STRING) for f in df.schema.fields]
    schema = row_type([field(n, k) for n, k in kinds])
    values = [col(n).cast("bigint").alias(n) if k == LONG else F.coalesce(col(n).cast("string"), F.lit("")).alias(n) for n, k in kinds]

    def number() -> Numbered:
        try:
            return Numbered(materialize(placed(df).select(PIECE, PLACE, *values)))
        except Exception as e:
            raise PipelineError(f"{label} source query failed: {first_line(e)}") from None

    null = [
        F.when(col(n).isNull(), F.concat(F.lit(f"Invalid {label} row seq="), F.col(SEQ).cast("string"), F.lit(f": field {n} is null"))) for n, k in kinds if k == LONG
    ]
    error = F.coalesce(*null) if null else F.lit(None).cast("string")
    return Rows(number, schema, prefix, finish=lambda rows: rows.select(SEQ, error.alias(ERR), *(col(n) for n, _ in kinds)))


def read(spark: SparkSession, source: Source) -> Rows:
    label = LABELS[source.type]
    options = {"url": source.url, "query": source.query, "driver": source.options.get("driver") or DRIVERS[source.type], "user": credential(label, source.user_env), "password": credential(label, source.password_env)}
    if source.fetch_size:
        options["fetchsize"] = str(source.fetch_size)
    try:
        return typed(spark.read.format("jdbc").options(**options).load(), label, source.type)
    except (PipelineError, StageError):
        raise
    except Exception as e:
        raise PipelineError(f"{label} source query failed: {first_line(e)}") from None


def first_line(e: Exception) -> str:
    """The first line of an error that says something; of a Java error, what follows the call it came from."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    if len(lines) > 1 and lines[0].startswith("An error occurred while calling"):
        return lines[1].removeprefix(": ").split("Exception: ", 1)[-1]
    return lines[0] if lines else type(e).__name__
