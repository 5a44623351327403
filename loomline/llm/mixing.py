"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.tokenize import TOKENIZERS, count_tokens
from loomline.plans.lineage import materialize

#: Residuals of so many partitions meet in one node of the reduction tree.
FAN_IN = 64
EPSILON = 1e-12
MASK = (1 << 64) - 1


def uniform(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) that depends on the seed and two documents only, so that a task run again decides alike."""
    x = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) & MASK
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) & MASK
    return (x ^ x >> 31) / 2**64


def transfer(pa: float, size_a: float, pb: float, size_b: float, u: float) -> tuple[float, float]:
    """One pivotal step: move mass (size times probability) between two fractions until one is 0 or 1.

    The mass of both together stays, and the direction is drawn so that each expectation stays.
    """
    up = min((1 - pa) * size_a, pb * size_b)  # from b to a
    down = min(pa * size_a, (1 - pb) * size_b)  # from a to b
    moved = up if u * (up + down) < down else -down
    pa, pb = pa + moved / size_a, pb - moved / size_b
    return tuple(0.0 if p < EPSILON else 1.0 if p > 1 - EPSILON else p for p in (pa, pb))


class Pivot:
    """Rounds the fractions of one source, one document after the other; at most one stays open."""

    def __init__(self, seed: int):
        self.seed, self.open = seed, None

    def add(self, key: int, size: int, base: int, p: float) -> Iterator[tuple[int, int, int]]:
        """(key, size, uses) of each document that is settled now."""
        if p < EPSILON or p > 1 - EPSILON:
            yield key, size, base + (p > 0.5)
            return
        if self.open is None:
            self.open = (key, size, base, p)
            return
        other, other_size, other_base, q = self.open
        q, p = transfer(q, other_size, p, size, uniform(self.seed, other, key))
        self.open = None
        for one in ((other, other_size, other_base, q), (key, size, base, p)):
            if 0 < one[3] < 1:
                self.open = one
            else:
                yield one[0], one[1], one[2] + int(one[3])


def plan(targets: list[dict], sizes: dict[str, int]) -> dict[str, tuple[int, float]]:
    """Per source the whole copies of each document and the probability of one more.

    The total is the size of all documents of the listed sources. A source whose share needs
    more than max_repeats copies gives max_repeats of each document and no more.
    """
    total = sum(sizes.get(t["source"], 0) for t in targets)
    out = {}
    for t in targets:
        have, cap = sizes.get(t["source"], 0), max(0, int(t["max_repeats"] or 0))
        copies = min(float(cap), max(0.0, t["target_share"] or 0.0) * total / have) if have else 0.0
        out[t["source"]] = (int(copies), copies - int(copies))
    return out


OUT = "source string, doc_id bigint, size bigint, uses bigint, p double, part int"


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 17, fan_in: int = FAN_IN, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, uses) of the chosen documents, and (source, target_share, target_tokens, actual_tokens, actual_share).

    Every document of a source gets the same expected number of copies. The fractions are rounded
    by the pivotal method: each partition keeps one open document per source, and a reduction
    tree (``fan_in`` partitions a node) pairs what is left over until one open document per source
    remains, which is drawn. A source's tokens thus miss its target by less than one document,
    however large it is, and no task holds more than one document or ``fan_in`` residuals per
    source at a time.

    ``targets`` (a configuration table: source, target_share, max_repeats) is read by the driver.
    Sources not listed, null sources, and null or empty texts stay out; shares are of the total
    size of the listed sources, so they add up to less than 1 where a source can't fill its share.
    Repeated doc_ids count as documents of their own. An empty table gives no documents and
    zero shares.
    """
    wanted = [r.asDict() for r in targets.where("source is not null").select("source", "target_share", "max_repeats").collect()]
    listed = docs.where(F.col("source").isin([t["source"] for t in wanted]) & (F.length("text") > 0))
    sized = materialize(count_tokens(listed, ["doc_id", "source"], name=name, folder=folder).where("n_tokens > 0"))
    sizes = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("size")).collect()}
    copies = plan(wanted, sizes)
    rounded = materialize(sized.mapInPandas(lambda pdfs: _round_partition(pdfs, copies, seed), OUT))
    settled, open_ = rounded.where("p = 0"), rounded.where("p > 0")
    parts, level = sized.rdd.getNumPartitions(), 0
    while True:
        parts, level = -(-parts // fan_in), level + 1
        nodes = open_.withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
        last, level_seed = parts <= 1, seed + level
        merged = nodes.groupBy("source", "part").applyInPandas(_node_rounder(level_seed, last), OUT)
        if last:
            settled = settled.unionByName(merged)
            break
        merged = materialize(merged)
        settled, open_ = settled.unionByName(merged.where("p = 0")), merged.where("p > 0")
    chosen = settled.where("uses > 0").select("doc_id", "source", F.col("size").alias("n_tokens"), "uses")
    total = sum(sizes.get(t["source"], 0) for t in wanted)
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("actual_tokens"))
    shares = (
        targets.where("source is not null")
        .select("source", "target_share")
        .join(used, "source", "left")
        .select(
            "source",
            "target_share",
            (F.col("target_share") * F.lit(float(total))).alias("target_tokens"),
            F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"),
            (F.coalesce("actual_tokens", F.lit(0)) / F.lit(float(max(total, 1)))).alias("actual_share"),
        )
    )
    return chosen, shares


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source", "doc_id", "size", "uses", "p", "part"])


def _round_partition(pdfs: Iterator[pd.DataFrame], copies: dict[str, tuple[int, float]], seed: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, pivots = TaskContext.get().partitionId(), {}
    for pdf in pdfs:
        rows = []
        for key, source, size in zip(pdf["doc_id"], pdf["source"], pdf["n_tokens"]):
            base, p = copies[source]
            pivot = pivots.setdefault(source, Pivot(seed))
            rows += [(source, k, s, uses, 0.0, part) for k, s, uses in pivot.add(int(key), int(size), base, p)]
        yield _frame(rows)
    yield _frame([(source, *p.open[:3], p.open[3], part) for source, p in pivots.items() if p.open])


def _node_rounder(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _round_node(pdf, seed, last)


def _round_node(pdf: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Pairs the open documents of one source; the last one stays open, or is drawn at the root."""
    pdf = pdf.sort_values(["doc_id", "size", "p"])
    source, part, pivot, rows = pdf["source"].iloc[0], int(pdf["part"].iloc[0]), Pivot(seed), []
    for key, size, base, p in zip(pdf["doc_id"], pdf["size"], pdf["uses"], pdf["p"]):
        rows += [(source, k, s, uses, 0.0, part) for k, s, uses in pivot.add(int(key), int(size), int(base), float(p))]
    if pivot.open:
        key, size, base, p = pivot.open
        rows.append((source, key, size, base + (uniform(seed, key, key) < p), 0.0, part) if last else (source, key, size, base, p, part))
    return _frame(rows)
