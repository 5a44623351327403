"""Records that share most of their content: inverted lists find pairs, sketches and exact similarity verify them.

One hash function orders all substrings of 8 characters. A record keeps its lowest values (its
bottom-k sketch), which estimate similarities. Inverted lists over values give the pairs to look
at. The list of a single value would hold a large part of the corpus wherever a phrase is common,
so lists are keyed by several values:

* records of up to 91 substrings have every run of 3 values that follow each other in hash order
  (of 2, up to 30 substrings): as more than two thirds of the union is shared, some run of 3 is
  shared by necessity, so this tier loses nothing;
* records of 64 and more have 80 lists of 5 values each, the least values of 5 of 400 equal ranges
  of hashes. Each is the same in both records with a probability of the similarity, whatever their
  sizes, and nearly independently of the others: a pair at the threshold shares 0.7^5 of the
  lists, 13 of 80, and none with a probability of (1 - 0.7^5)^80 = 4e-7. Where a record has no
  value in a range, it takes the least of another range, by the first of a fixed order that has
  one (optimal densification), which keeps the probability.

Sizes of two similar records differ by a factor of 0.7 at most, and the tiers overlap by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.graph import connected_components
from loomline.operators.skew import blocked_pairs, counted_lookup, expanded_pairs, hot_aware_lookup
from loomline.plans.lineage import materialize, release

THRESHOLD = 0.7
#: Characters of a substring.
GRAM = 8
#: Values that lists are made of: all that a set has.
K = 1 << 32
#: Lists of a long record, and the ranges of hashes that each takes the least value of.
BANDS, BAND = 80, 5
RANGES = BANDS * BAND
#: Largest set of the tiers with runs of 1, 2 and 3; smallest set of the sketched tier.
TIER_1, TIER_2, TIER_3, SKETCHED = 2, 30, 91, 64
#: Values of the union sketch that estimate a similarity, and the estimate below which a pair is
#: dropped: more than five standard deviations under the threshold.
ESTIMATE_K, ESTIMATE_MIN = 64, 0.4
NONE = np.uint32(0xFFFFFFFF)

NOT_KEPT = r"[^\p{L}\p{M}\p{Nd}]+"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def gram_hashes(text: str) -> np.ndarray:
    """The sorted distinct hashes (32 bits) of the substrings of 8 characters of ``text``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    factor, width = np.uint64(0x100000001B3), 1
    while width < GRAM:
        points = mix(points[:-width] * factor + points[width:])
        width *= 2
    return np.unique((points >> np.uint64(32)).astype(np.uint32))


#: First hash of each range and the end of the last, and the order in which an empty range looks at others.
EDGES = -(-(np.arange(RANGES + 1, dtype=np.int64) << 32) // RANGES)
DETOURS = np.random.Generator(np.random.PCG64(11)).integers(0, RANGES, (1 << 12, RANGES))


def band_keys(values: np.ndarray) -> np.ndarray:
    """Keys of the lists of a long record: each of the least values of ``BAND`` ranges. ``values``: its set in order."""
    first = np.searchsorted(values, EDGES.astype(np.uint64))
    filled = first[:-1] < first[1:]
    source = np.arange(RANGES)
    empty = np.flatnonzero(~filled)
    for detour in DETOURS:
        if not len(empty):
            break
        source[empty] = detour[empty]
        empty = empty[~filled[source[empty]]]
    source[empty] = np.flatnonzero(filled)[0]  # the first, were the order ever at its end
    least = values[first[source]].reshape(BANDS, BAND).astype(np.uint64)
    key = mix(least[:, 0] + (np.arange(BANDS, dtype=np.uint64) + np.uint64(8) << np.uint64(40)))
    for i in range(1, BAND):
        key = mix(key * np.uint64(0x100000001B3) + least[:, i])
    return key


def run_keys(sketch: np.ndarray, n: int) -> np.ndarray:
    """Keys of the inverted lists that a record is in. ``sketch``: its values in order; ``n``: its set's size."""
    out = []
    if n <= TIER_1:
        out.append(_runs(sketch, 1))
    if n <= TIER_2:
        out.append(_runs(sketch, 2))
    if 21 <= n <= TIER_3:
        out.append(_runs(sketch, 3))
    if n >= SKETCHED:
        out.append(band_keys(sketch))
    return np.unique(np.concatenate(out))


def _runs(values: np.ndarray, length: int) -> np.ndarray:
    count = max(0, len(values) - length + 1)
    key = mix(values[:count].astype(np.uint64) + np.uint64(length << 40))
    for i in range(1, length):
        key = mix(key * np.uint64(0x100000001B3) + values[i : i + count])
    return key


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity estimated from the sketch of the union: the share of its lowest values that both have."""
    union, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((counts[:ESTIMATE_K] == 2).mean())


def jaccard(a: str, b: str) -> float:
    """Exact similarity of two texts by their sets of substrings."""
    a, b = ({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} for t in (a, b))
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


def distinct_contents(docs: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(rep, norm, copies, sketch, keys, n) of each distinct content, and (key, rep) of each row; both materialised.

    ``rep`` is the smallest key with the content. Contents are compared in lower case by letters,
    marks and digits alone; null ones and those of fewer than 8 such characters are left out.
    """
    norm = F.regexp_replace(F.lower(content), NOT_KEPT, "")
    texts = docs.select(F.col(key).cast("bigint").alias("key"), norm.alias("norm")).where("key is not null")
    # Texts are brought to their form once; what follows reads the texts or their digests of this table.
    stored = materialize(texts.withColumn("digest", F.when(F.length("norm") >= GRAM, F.unhex(F.md5("norm")))))
    texts = stored.where("digest is not null")
    grouped = texts.groupBy("norm").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_hashes(t) for t in batch.column(0).to_pylist()]
            sketches = pa.array([s[:ESTIMATE_K].tobytes() for s in sets], pa.binary())
            keys = pa.array([run_keys(s, len(s)).tobytes() for s in sets], pa.binary())
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, sketches, keys, sizes], ["norm", "rep", "copies", "sketch", "keys", "n"])

    reps = materialize(grouped.mapInArrow(run, "norm string, rep bigint, copies bigint, sketch binary, keys binary, n int"))
    by_digest = reps.select(F.unhex(F.md5("norm")).alias("digest"), "rep", "copies")
    members = materialize(hot_aware_lookup(texts.select("key", "digest"), by_digest, "digest", "copies").select("key", "rep"))
    release(stored)
    return reps, members


def similar_contents(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity), a < b: representatives of different contents with at least the threshold; materialised."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            ids = np.repeat(batch.column(0).to_numpy(), [len(k) // 8 for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(ids)], ["run", "rep"])

    entries = reps.select("rep", "keys").mapInArrow(lists, "run bigint, rep bigint")
    # Lists of one record, nearly all, end here; the rest is a small table.
    shared = materialize(entries.groupBy("run").agg(F.count("*").alias("_n"), F.min("rep").alias("first"), F.max("rep").alias("last")).where("_n > 1"))
    # Most lists of several records hold two of them: their pair is there after aggregation.
    twos = shared.where("_n = 2").select(F.col("first").alias("rep_a"), F.col("last").alias("rep_b"))
    longer = materialize(hot_aware_lookup(entries, shared.where("_n > 2").select("run", "_n"), "run", "_n"))
    pairs = materialize(twos.unionByName(blocked_pairs(longer, "run", "rep")).distinct())
    release(shared, longer)
    # Sketches are looked up first: texts move only for pairs that their estimate lets through.
    fits = F.least("n_a", "n_b") >= F.floor(F.lit(threshold) * F.greatest("n_a", "n_b") * 0.98)
    sketched = both_sides(pairs, reps.select("rep", "sketch", "n"), 1 << 20).where(fits)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(i).to_pylist() for i in (2, 3))
            kept = [estimate(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)) >= ESTIMATE_MIN for a, b in zip(*sides)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["rep_a", "rep_b"]).filter(pa.array(kept, pa.bool_()))

    survivors = materialize(sketched.select("rep_a", "rep_b", "sketch_a", "sketch_b").mapInArrow(likely, "rep_a bigint, rep_b bigint"))
    release(pairs)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similarity = [jaccard(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            kept = pa.array([j >= threshold for j in similarity], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity, pa.float64())], ["a", "b", "similarity"]).filter(kept)

    both = both_sides(survivors, reps.select("rep", "norm"), 1 << 14).select("rep_a", "rep_b", "norm_a", "norm_b")
    similar = materialize(both.mapInArrow(verify, "a bigint, b bigint, similarity double"))
    release(survivors)
    return similar


def both_sides(pairs: DataFrame, sides: DataFrame, rows_per_salt: int) -> DataFrame:
    """The columns of both representatives of each stored pair, with the suffixes ``_a`` and ``_b``; popular ones are salted."""
    rows = pairs
    for s in "ab":
        rows = counted_lookup(rows, sides.select([F.col(c).alias(f"{c}_{s}") for c in sides.columns]), f"rep_{s}", pairs, rows_per_salt)
    return rows


def near_duplicate_pairs(docs: DataFrame, key: str = "doc_id", content: str = "content", threshold: float = THRESHOLD) -> DataFrame:
    """(<key>_a, <key>_b), a < b: every two rows whose contents have at least the similarity, equal ones included.

    Null keys, null contents and those with fewer than 8 letters, marks and digits take no part.
    Repeated rows of one key are one document. An empty table gives no pair.
    """
    reps, members = distinct_contents(docs, key, content)
    members = materialize(members.distinct())
    same = blocked_pairs(members, "rep", "key").select("key_a", "key_b")
    similar = similar_contents(reps, threshold)
    expanded = expanded_pairs(similar, "a", "b", members, "rep", "key")
    ordered = expanded.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
    return same.unionByName(ordered).select(F.col("key_a").alias(f"{key}_a"), F.col("key_b").alias(f"{key}_b"))


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", content: str = "content", threshold: float = THRESHOLD) -> DataFrame:
    """(key, group_id, n_links): one row per document that takes part.

    ``group_id`` is the smallest key of the documents connected by similarity; ``n_links`` counts
    the other contents that are similar to the document's own, and its own other copies.
    """
    reps, members = distinct_contents(docs, key, content)
    similar = similar_contents(reps, threshold)
    components = connected_components(similar, "a", "b").withColumnRenamed("node", "rep")
    degree = similar.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    classes = (
        reps.select("rep", "copies")
        .join(components, "rep", "left")
        .join(degree, "rep", "left")
        .select("rep", F.coalesce("component", "rep").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    )
    return hot_aware_lookup(members, classes, "rep", "copies").select(F.col("key").alias(key), "group_id", "n_links")
