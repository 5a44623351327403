"""Joins and pair generation that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.plans.lineage import materialize

#: Rows of a key that one salt takes. Every key of more rows is salted; there can be one such key
#: for each so many rows at most, so their list (40 bytes a key) is 40 MB where there are 10^12 rows.
ROWS_PER_SALT = 1 << 20


def hot_aware_lookup(facts: DataFrame, dim: DataFrame, key: str, weight: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Inner join of ``facts`` with ``dim`` on ``key``; ``dim`` has each key once.

    ``weight`` names the column of ``dim`` with the number of fact rows of the key. All keys of more
    than ``rows_per_salt`` rows are spread over salts: their fact rows by a hash of the row, their
    one row of ``dim`` by a copy for each salt. Everything moves in one shuffle join, and ``facts``
    is evaluated once. Null keys match nothing. The weight is dropped.
    """
    return _salted(facts, dim.drop(weight), key, dim.select(key, F.col(weight).alias("_weight")), rows_per_salt)


def _salted(facts: DataFrame, dim: DataFrame, key: str, weights: DataFrame, rows_per_salt: int) -> DataFrame:
    heavy = weights.where(F.col("_weight") > rows_per_salt)  # one key for each rows_per_salt rows at most
    heavy = F.broadcast(heavy.select(F.col(key).alias("_hot_key"), F.ceil(F.col("_weight") / F.lit(rows_per_salt)).cast("int").alias("_salts")))
    rest = [c for c in dim.columns if c != key]
    row_hash = F.xxhash64(*facts.columns)
    salted = facts.join(heavy, F.col(key) == F.col("_hot_key"), "left").select(
        *facts.columns, F.when(F.col("_salts").isNotNull(), F.pmod(row_hash, F.col("_salts")).cast("int")).otherwise(0).alias("_salt")
    )
    copies = dim.join(heavy, F.col(key) == F.col("_hot_key"), "left").select(
        key, *rest, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt")
    )
    return salted.join(copies, [key, "_salt"]).select(*facts.columns, *rest)


def blocked_pairs(members: DataFrame, key: str, item: str, block_rows: int = 2000, where: Column | None = None) -> DataFrame:
    """All pairs ``(<item>_a, <item>_b)`` with a < b of rows that share ``key``; ``members`` has (key, item, ...).

    A key with more than ``block_rows`` rows is cut into blocks by a hash of the item, and the
    pairs of each two blocks become a join key of their own. So the pairs of one hot key are made
    by many tasks, and none of them holds more than two blocks. All columns but the key come out
    twice, with the suffixes ``_a`` and ``_b``. Repeated rows of one item give repeated pairs.
    ``members`` is read twice, so it should be a table or cheap.
    """
    counted = members.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = counted.select(key, F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_blocks"), "_n")
    sized = hot_aware_lookup(members, blocks, key, "_n")
    sized = sized.withColumn("_block", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    rest = [c for c in members.columns if c != key]
    # A row of block i takes part in the block pairs (min(i, j), max(i, j)) for every j.
    spread = sized.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        key, F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"), "_block", *rest
    )
    left, right = (
        spread.select(key, "_lo", "_hi", F.col("_block").alias(f"_block{s}"), *[F.col(c).alias(f"{c}{s}") for c in rest]) for s in ("_a", "_b")
    )
    # Of the block pair (i, j), i < j, only pairs across the blocks; those within i come from (i, i).
    across = (F.col("_lo") == F.col("_hi")) | (F.col("_block_a") != F.col("_block_b"))
    pairs = left.join(right, [key, "_lo", "_hi"]).where((F.col(f"{item}_a") < F.col(f"{item}_b")) & across)
    if where is not None:
        pairs = pairs.where(where)
    return pairs.drop(key, "_lo", "_hi", "_block_a", "_block_b")


def counted_lookup(facts: DataFrame, dim: DataFrame, key: str, counted: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """:func:`hot_aware_lookup` where the fact rows of each key have to be counted first.

    They are counted in ``counted``, a stored table that has the same rows: the plan of ``facts``,
    which may hold several lookups, then occurs once.
    """
    return _salted(facts, dim, key, counted.groupBy(key).agg(F.count("*").alias("_weight")), rows_per_salt)


def expanded_pairs(pairs: DataFrame, a: str, b: str, members: DataFrame, group: str, item: str, block_rows: int = 1000) -> DataFrame:
    """(<item>_a, <item>_b): every member of group ``a`` with every member of group ``b``, for each pair of groups.

    ``members`` has (group, item). Members become lists of about ``block_rows``; the pairs of lists
    are rows of their own, so that the members of two large groups meet in as many tasks as their
    number asks for. A group with many partners is salted. ``pairs`` and ``members`` are stored tables.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("_n"))
    sizes = materialize(sizes.select(group, F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_blocks"), "_n"))
    placed = hot_aware_lookup(members, sizes, group, "_n").withColumn("_block", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    lists = materialize(placed.groupBy(F.struct(group, "_block").alias("_list")).agg(F.collect_list(item).alias("_items")))
    rows = pairs.select(a, b)
    for side in (a, b):
        rows = counted_lookup(rows, sizes.select(F.col(group).alias(side), F.col("_blocks").alias(f"_{side}_blocks")), side, pairs)
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"_{side}_blocks") - 1))
    rows = rows.withColumn("_i", every(a)).withColumn("_j", every(b))
    list_of = lambda side, block: F.struct(F.col(side).alias(group), F.col(block).alias("_block"))
    blocks = materialize(rows.select(list_of(a, "_i").alias("_list_a"), list_of(b, "_j").alias("_list_b")))
    # A row that carries one list of items is some kilobytes wide, hence fewer rows a salt.
    rows = blocks
    for side in ("_list_a", "_list_b"):
        rows = counted_lookup(rows, lists.select(F.col("_list").alias(side), F.col("_items").alias(f"{side}_items")), side, blocks, 1 << 14)
    return rows.select(F.explode("_list_a_items").alias(f"{item}_a"), "_list_b_items").select(f"{item}_a", F.explode("_list_b_items").alias(f"{item}_b"))
