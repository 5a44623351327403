"""String functions with the semantics that pipelines are defined by: UTF-16 lengths, control-character trimming."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: All characters up to U+0020: what trimming takes away, and nothing else.
TRIMMED = "".join(map(chr, range(0x21)))


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units (bigint): a supplementary character counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def parse_long(text: Column) -> Column:
    """A signed 64-bit number with control characters and spaces around it, or null."""
    bare = trimmed(text)
    return F.when(bare.rlike(r"^[+-]?[0-9]+\z"), bare.try_cast("bigint"))


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL, as expressions that are planned like any other."""
    marks = "".join(f"\\u{i:04x}" for i in range(0x21))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION utf16_length(s STRING) RETURNS BIGINT RETURN cast(octet_length(encode(s, 'UTF-16BE')) / 2 AS BIGINT)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION trim_controls(s STRING) RETURNS STRING RETURN btrim(s, '{marks}')")
