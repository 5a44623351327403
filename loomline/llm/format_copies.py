"""Records that differ in formatting only, found by dictionary encoding.

Each distinct field value is canonicalised once and gets an integer; a record becomes the sorted
tuple of its (name, value) integers; equal tuples are copies. Texts are moved once, to find the
distinct ones; all further steps move digests and integers.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from loomline.operators.skew import hot_aware_lookup
from loomline.plans.lineage import materialize, release

WORD_CHARS = r"\p{L}\p{M}\p{Nd}"
FIELDS = ArrayType(StructType([StructField("name", StringType()), StructField("value", StringType())]))


def words(text: Column) -> Column:
    """The words (maximal runs of letters, marks and digits) in lower case, parted by one space."""
    return F.btrim(F.regexp_replace(F.lower(text), f"[^{WORD_CHARS}]+", " "))


@F.pandas_udf(FIELDS)
def json_fields(texts: pd.Series) -> pd.Series:
    """Name and value of each field of a flat JSON object of strings; null for anything else."""

    def parse(text: str | None) -> list | None:
        if text is None:
            return None
        try:
            pairs = json.loads(text, object_pairs_hook=lambda pairs: tuple(pairs))
        except (ValueError, RecursionError):
            return None
        if not isinstance(pairs, tuple) or not all(isinstance(v, str) for _, v in pairs):
            return None
        # Of a repeated name the last value counts; escaped lone surrogates can't be stored.
        return [{"name": k.encode("utf-8", "replace").decode(), "value": v.encode("utf-8", "replace").decode()} for k, v in dict(pairs).items()]

    return texts.map(parse)


def with_fields(records: DataFrame) -> DataFrame:
    """``records`` (tbl, id, content) one row a field: (tbl, id, name, value); a prose record is one value without name."""
    text = F.col("content")
    lines = F.filter(F.split(text, "\r\n|\r|\n"), lambda line: line.rlike(r"[^\s\p{Z}]"))
    one_word = rf"^[^:{WORD_CHARS}]*[{WORD_CHARS}]+[^:{WORD_CHARS}]*:"
    by_line = F.transform(
        lines, lambda line: F.struct(F.substring_index(line, ":", 1).alias("name"), F.substr(line, F.instr(line, ":") + 1).alias("value"))
    )
    prose = F.array(F.struct(F.lit(None).cast("string").alias("name"), text.alias("value")))
    found = (
        records.where(text.rlike(f"[{WORD_CHARS}]"))
        .withColumn("_json", json_fields(F.when(F.btrim(text, F.lit(" \t\r\n")).startswith("{"), text)))
        .withColumn("_lines", lines)
        .withColumn(
            "_fields",
            F.when(F.col("_json").isNotNull(), F.col("_json"))
            .when(F.forall("_lines", lambda line: line.rlike(one_word)), by_line)
            .otherwise(prose),
        )
    )
    return found.select("tbl", "id", F.explode("_fields").alias("_field")).select("tbl", "id", "_field.name", "_field.value")


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def copy_tuples(records: DataFrame) -> DataFrame:
    """(tbl, id, tuple): every record of (tbl, id, content) that has a letter or digit, as its tuple of integers.

    The tuple is written as sorted ``name:value`` numbers; prose has no name. Equal tuples of a
    table are copies. Materialised. Records whose content is null or has no word are left out.
    """
    # Records are parsed once: the dictionary reads the strings of this table, the tuples their digests.
    fields = materialize(with_fields(records).select("tbl", "id", "name", "value", digest("name").alias("name_key"), digest("value").alias("value_key")))
    narrow = fields.select("tbl", "id", "name_key", "value_key")
    strings = fields.select(F.explode(F.array("name", "value")).alias("s")).where("s is not null")
    distinct = strings.groupBy("s").agg(F.count("*").alias("n"))
    canonical = materialize(distinct.select(digest("s").alias("key"), digest(words(F.col("s"))).alias("form"), "n"))
    forms = materialize(canonical.groupBy("form").agg(F.count("*").alias("spellings")).withColumn("code", F.monotonically_increasing_id()))
    dictionary = materialize(hot_aware_lookup(canonical, forms, "form", "spellings").select("key", "code", "n"))
    release(canonical, forms)
    values = dictionary.select(F.col("key").alias("value_key"), F.col("code").alias("value_code"), "n")
    names = dictionary.select(F.col("key").alias("name_key"), F.col("code").alias("name_code"), "n")
    coded = hot_aware_lookup(narrow, values, "value_key", "n").drop("value_key")
    coded = materialize(coded)
    release(fields)
    prose = coded.where("name_key is null").select("tbl", "id", F.concat(F.lit(":"), F.col("value_code")).alias("tuple"))
    named = hot_aware_lookup(coded.where("name_key is not null"), names, "name_key", "n")
    pair = F.struct("name_code", "value_code")
    rewritten = named.groupBy("tbl", "id").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    shown = F.array_join(F.transform("pairs", lambda p: F.concat(p.name_code, F.lit(":"), p.value_code)), ",")
    return materialize(prose.unionByName(rewritten.select("tbl", "id", shown.alias("tuple"))))


def copy_groups(records: DataFrame) -> DataFrame:
    """(tbl, kept_id, n_rows) of every group of equal records, single ones included."""
    return copy_tuples(records).groupBy("tbl", "tuple").agg(F.min("id").alias("kept_id"), F.count("*").alias("n_rows")).drop("tuple")


def copies(records: DataFrame) -> DataFrame:
    """(tbl, kept_id, copy_id): one row for each record but the one with the smallest id of its group.

    Equal are contents with the same words in the same order, and records of named fields (flat
    JSON objects of strings, or lines ``name: value``) with the same fields in any order. Null
    contents and those without a letter or digit take no part; an empty table gives no row.
    """
    tuples = copy_tuples(records).withColumn("group", F.struct("tbl", "tuple"))
    groups = tuples.groupBy("group").agg(F.min("id").alias("kept_id"), F.count("*").alias("n")).where("n > 1")
    return hot_aware_lookup(tuples.select("group", "id"), groups, "group", "n").where("id <> kept_id").select("group.tbl", "kept_id", F.col("id").alias("copy_id"))
