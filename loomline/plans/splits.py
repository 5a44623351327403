"""Splits, bundles and batches: how the numbered rows of a source are divided."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.errors import PipelineError
from loomline.schema import ERR, SEQ


@dataclass(frozen=True)
class Split:
    """Rows ``start`` to ``end``, both included."""

    id: str
    start: int
    end: int

    def __post_init__(self) -> None:
        if not self.id.strip() or self.start < 1 or self.end < self.start:
            raise PipelineError(f"Invalid source split: {self}")


def plan(prefix: str, total: int, rows: int | None) -> list[Split]:
    """Contiguous splits of ``rows`` rows; one whole one, ``prefix-0``, for a source that isn't divided or is empty."""
    if not rows or total <= 0:
        return [Split(f"{prefix}-0", 1, max(total, 2**63 - 1))]
    return [Split(f"{prefix}-part-{k}", k * rows + 1, min((k + 1) * rows, total)) for k in range(-(-total // rows))]


def bundles(splits: list[Split], most: int) -> list[list[Split]]:
    """Contiguous groups of splits, ``most`` at most, of equal size but for the last."""
    if most < 1:
        raise PipelineError(f"Invalid maxParallelism: {most}")
    size = -(-len(splits) // max(1, min(len(splits), most)))
    return [splits[i : i + size] for i in range(0, len(splits), size)] if splits else []


def split_number(seq: Column, rows: int | None) -> Column:
    return F.floor((seq - 1) / rows).cast("bigint") if rows else F.lit(0).cast("bigint")


#: Places of one block when the marked rows before a row are counted.
BLOCK = 1 << 14


def marks_before(rows: DataFrame, marked: Column, group: list[str], at: str) -> DataFrame:
    """Adds ``_marks``, the marked rows of the group up to each row's place, its own included, and ``_last``, the place of the last one.

    Places are numbers that occur once in a group. Marked places are listed by block of places, and
    sums and last places are carried over blocks, so that no window runs over the rows themselves.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    blocks = blocked.groupBy(*group, "_block").agg(F.sort_array(F.collect_list(F.when(marked, F.col(at)))).alias("_in"))
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(
        *group, "_block", "_in", F.coalesce(F.sum(F.size("_in")).over(earlier), F.lit(0)).alias("_before"), F.max(F.try_element_at("_in", F.lit(-1))).over(earlier).alias("_latest")
    ).where((F.col("_before") > 0) | (F.size("_in") > 0))
    joined = blocked.join(carried, [*group, "_block"], "left")
    here = F.filter("_in", lambda x: x <= F.col(at))
    marks = F.coalesce(F.col("_before"), F.lit(0)) + F.when(F.col("_in").isNull(), 0).otherwise(F.size(here))
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), marks.cast("bigint").alias("_marks"), F.coalesce(F.try_element_at(here, F.lit(-1)), F.col("_latest")).alias("_last"))


def with_batches(rows: DataFrame, rows_per_split: int | None, batch_size: int, after: int = 0, sound: bool = False) -> DataFrame:
    """Adds ``_b_split``, ``_b_part`` and ``_b_no``: the flush that each source row belongs to.

    A flush ends after ``batch_size`` rows, at the end of a split and before a bad record. Rows are
    numbered without gaps, so that a flush is arithmetic on a row's number and the last bad record
    before it. Rows up to ``after``, which an earlier run has done, count nowhere and are gone.
    ``sound`` says that no record is bad.
    """
    left = rows.where(F.col(SEQ) > after) if after else rows
    split = left.withColumn("_b_split", split_number(F.col(SEQ), rows_per_split))
    first = F.greatest(F.col("_b_split") * (rows_per_split or 0), F.lit(after).cast("bigint"))  # the last row before the split's own
    if sound:
        part, before = F.lit(0).cast("bigint"), first
    else:
        split = marks_before(split, F.col(ERR).isNotNull(), ["_b_split"], SEQ)
        part, before = F.col("_marks"), F.coalesce("_last", first)
    number = F.when(F.col(ERR).isNotNull(), 0).otherwise(F.floor((F.col(SEQ) - before - 1) / batch_size)).cast("bigint")
    return split.withColumn("_b_part", part).withColumn("_b_no", number).drop("_marks", "_last")


#: Numbers of one window when gapless runs are looked for.
BUCKET = 1 << 20


def runs(df: DataFrame, number: str) -> DataFrame:
    """(first, last, rows) of every gapless run of the numbers in ``number``, repeated and null ones aside.

    Runs are found bucket by bucket in parallel. Only the pieces that touch a bucket's edge, two a
    bucket at most, are then joined in one window.
    """
    numbers = df.select(F.col(number).cast("bigint").alias("n")).where("n is not null").distinct().withColumn("_bucket", F.floor(F.col("n") / BUCKET))
    island = F.col("n") - F.row_number().over(W.partitionBy("_bucket").orderBy("n"))
    pieces = numbers.withColumn("_island", island).groupBy("_bucket", "_island").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("rows"))
    edge = (F.pmod("first", F.lit(BUCKET)) == 0) | (F.pmod("last", F.lit(BUCKET)) == BUCKET - 1)
    in_order = W.orderBy("first")
    fresh = F.coalesce((F.col("first") != F.lag("last").over(in_order) + 1).cast("bigint"), F.lit(1))
    joined = pieces.where(edge).withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    joined = joined.groupBy("_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows")).drop("_run")
    return pieces.where(~edge).select("first", "last", "rows").unionByName(joined)
