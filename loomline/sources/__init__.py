"""Sources: tables of rows with ``_seq`` (1-based, in source order, bad records included) and ``_err``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.config import Source
from loomline.errors import PipelineError
from loomline.plans.lineage import materialize
from loomline.schema import PIECE, PLACE, SEQ

#: Rows of a split where the pipeline doesn't say.
ROWS_PER_SPLIT = 10_000
#: Pieces that a range of rows names in its scan; a range over more of them is read by its numbers alone.
MOST_PIECES = 500


class Numbered:
    """A table written once, whose rows are numbered by the piece of the source they come from.

    A piece is a block of a file or a partition of a query's result, with rows in order. The
    pieces' sizes are added up in the order of their names, a table as small as the number of
    pieces, so that rows get numbers without a shuffle. As pieces and places are stored, reading
    the table again gives the same numbers whatever the plan, which holds for no query's result.
    """

    def __init__(self, table: DataFrame, number: str = SEQ):
        self.table, self.number = table, number
        sizes = table.groupBy(PIECE).agg(F.count("*").alias("_rows"), F.min(PLACE).alias("_first"))
        before = F.coalesce(F.sum("_rows").over(W.orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        self.pieces = materialize(sizes.select(F.col(PIECE).alias("_piece"), "_rows", "_first", before.alias("_before")))  # a row a piece
        self.total = self.pieces.agg(F.sum("_rows")).first()[0] or 0

    def between(self, first: int = 1, last: int = 2**63 - 1) -> DataFrame:
        """The rows with these numbers. The pieces they lie in are named to the scan, which skips all others."""
        rows = self.table
        if first > 1 or last < self.total:
            inside = (F.col("_before") < last) & (F.col("_before") + F.col("_rows") >= first)
            names = [r[0] for r in self.pieces.where(inside).select("_piece").limit(MOST_PIECES + 1).collect()]
            if len(names) <= MOST_PIECES:
                rows = rows.where(F.col(PIECE).isin(names))
        number = (F.col("_before") + F.col(PLACE) - F.col("_first") + 1).cast("bigint").alias(self.number)
        others = [c for c in rows.columns if c not in (PIECE, PLACE)]
        rows = rows.join(self.pieces, F.col(PIECE) == F.col("_piece")).select(number, *(F.col(f"`{c}`") for c in others))
        return rows.where(F.col(self.number).between(first, last)) if first > 1 or last < self.total else rows


def placed(df: DataFrame, piece: Column | None = None) -> DataFrame:
    """Adds the piece (by default the partition of the result) and the place of each row in it."""
    piece = F.lpad(F.spark_partition_id().cast("string"), 12, "0") if piece is None else piece
    return df.withColumn(PIECE, piece).withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))


def file_piece() -> Column:
    """The block of a file, named so that names have the order of files and of blocks in them."""
    return F.concat(F.col("_metadata.file_path"), F.lit(":"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))


class Rows:
    """An opened source. ``df`` has ``_seq``, ``_err`` (null for a good record) and the fields of ``schema``.

    ``df`` may be given as a table, or as what reads the source once: a function that gives
    :class:`Numbered` rows and one that finishes them. Nothing is read before ``df`` is asked for.
    """

    def __init__(self, df: DataFrame | Callable[[], Numbered], schema: StructType, split_prefix: str, rows_per_split: int | None = None, finish: Callable[[DataFrame], DataFrame] | None = None):
        self._df, self.schema, self.split_prefix, self.rows_per_split = df, schema, split_prefix, rows_per_split  # no rows per split: one split
        self._numbered, self._finish = None, finish or (lambda rows: rows)

    def between(self, first: int = 1, last: int = 2**63 - 1) -> DataFrame:
        if isinstance(self._df, DataFrame):
            return self._df.where(F.col(SEQ).between(first, last)) if first > 1 or last < 2**63 - 1 else self._df
        if self._numbered is None:
            self._numbered = self._df()
        return self._finish(self._numbered.between(first, last))

    @property
    def df(self) -> DataFrame:
        return self.between()


#: Makers of sources by type, beside the built-in ones: (session, settings) -> Rows. Added by :func:`register`.
REGISTERED: dict[str, Callable[[SparkSession, Source], Rows]] = {}


def register(name: str, make: Callable[[SparkSession, Source], Rows]) -> None:
    REGISTERED[name] = make


def open_source(spark: SparkSession, source: Source) -> Rows:
    """Builds the table of a source. Its schema is known after this, so transforms can be checked; hardly a row has been read."""
    from loomline.sources import documents, files, jdbc, paths, sql

    if source.type == "file":
        paths.configure(spark, source)
        if source.format == "document":
            return documents.read(spark, source)
        rows = files.read_csv(spark, source) if source.format == "csv" else files.read_jsonl(spark, source)
        rows.rows_per_split = source.max_rows_per_split or ROWS_PER_SPLIT
        return rows
    if source.type == "duckdb":
        return sql.read(spark, source)
    if source.type in ("postgres", "mysql"):
        return jdbc.read(spark, source)
    if source.type in REGISTERED:
        return REGISTERED[source.type](spark, source)
    raise PipelineError(f"Unsupported source.type: {source.type}")
