"""The k most similar vectors of every vector: score-aware quantisation, table scans, exact reranking.

Vectors are brought to length 1, so that the inner product is the cosine. A coarse quantiser
(k-means) cuts space into cells; what is left of a vector beside its cell's centre is written as
its length and, scaled to length 1 so that dense and sparse places are told apart equally well,
in four bits for each two dimensions. The codes are chosen score-aware: the part of the residual
error that is parallel to the vector, which changes scores, costs ``ETA`` times the orthogonal
part. A query looks up the inner products of its parts with all 16 code words, two codes a byte,
and scans the codes of its nearest cells by table look-ups alone; where many queries scan a cell,
the code words are looked up once and multiplied with all of them, which gives the same sums. The
best of all scans are ranked again by exact inner products.

Neighbouring cells share a region, and regions are what tasks work on: the cells that a query scans
lie in two or three regions, so that its vector is sent as often, and not once for each cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.plans.lineage import materialize, release

#: Rows that a cell holds on average, and the most cells (the size of what is broadcast: 16 MB at 64 dimensions).
CELL_ROWS, MOST_CELLS = 800, 65536
#: Cells of a region on average.
REGION_CELLS = 12
#: Rows of the sample that centres and code words are fitted on, per cell and at most. Every row is indexed.
SAMPLE_PER_CELL, MOST_SAMPLE = 48, 400_000
#: Cells that a query scans at least, and candidates of a region that are ranked exactly.
PROBES, CANDIDATES = 6, 144
#: Queries whose neighbours are looked up in the whole table to choose the cells scanned, and the share of these neighbours that must lie in them.
TRIAL_QUERIES, TRIAL_RECALL = 512, 0.99
#: Weight of the parallel error: (d - 1) T² / (1 - T²) for the score threshold T = 0.2 in 64 dimensions.
ETA = 2.6
#: Rows of a region that one task scans at a time, and queries that come with them; larger regions are cut.
ITEM_CHUNK, QUERY_CHUNK = 65536, 32768
WORDS, PART = 16, 2


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of a bounded sample. An empty cell restarts at a random point."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=k)
        empty = counts == 0
        sums[empty], counts[empty] = points[rng.choice(len(points), int(empty.sum()))], 1
        centres = (sums / counts[:, None]).astype(np.float32)
    return centres


def kmeans_tree(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` centres of a bounded sample in two levels, so that the work grows with k's root: centres of about sqrt(k) groups, and those of each group by its size."""
    if k <= 64:
        return kmeans(points, k, rounds)
    top = kmeans(points, int(np.sqrt(k)), rounds)
    group = nearest(points, top)
    sizes = np.bincount(group, minlength=len(top))
    share = sizes * k / len(points)
    counts = np.minimum(np.maximum(np.floor(share), sizes > 0), sizes).astype(int)
    for g in np.argsort(counts - share):  # what is left, where most is missing
        if counts.sum() < k and counts[g] < sizes[g]:
            counts[g] += 1
    return np.concatenate([kmeans(points[group == g], n, rounds, 5 + g) for g, n in enumerate(counts) if n])


def nearest(points: np.ndarray, centres: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    step = max(1, most // len(centres))
    return np.concatenate([(points[i : i + step] @ centres.T - half).argmax(1) for i in range(0, len(points), step)])


class Quantiser:
    """Four-bit codes of residuals, two dimensions each, fitted and assigned by the score-aware loss."""

    def __init__(self, words: np.ndarray, eta: float = ETA):
        self.words, self.eta = words, eta  # words: (parts, 16, 2)

    @classmethod
    def fit(cls, vectors: np.ndarray, residuals: np.ndarray, eta: float = ETA, rounds: int = 4) -> Quantiser:
        parts = residuals.shape[1] // PART
        words = np.stack([kmeans(residuals[:, PART * m : PART * m + PART], WORDS, 6, m) for m in range(parts)])
        quantiser = cls(words, eta)
        for _ in range(rounds):
            codes = quantiser.assign(vectors, residuals)
            quantiser._update(vectors, residuals, codes)
        return quantiser

    def assign(self, vectors: np.ndarray, residuals: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Coordinate descent over the parts: |e|² + (eta - 1) (e·x)² for the error e of the vector x.

        Squares and products are expanded, so that a part costs two products with its 16 words.
        """
        n, parts, words = len(residuals), len(self.words), self.words.astype(np.float32)
        r, x = (np.ascontiguousarray(a.reshape(n, parts, PART).transpose(1, 0, 2), np.float32) for a in (residuals, vectors))
        codes, rows, eta = np.zeros((parts, n), np.uint8), np.arange(n), np.float32(self.eta - 1)
        plain = [(w**2).sum(1) - 2 * (a @ w.T) for w, a in zip(words, r)]  # |e|² less |r|², of each word
        onto = [a @ w.T for w, a in zip(words, x)]  # w·x
        rx = (r * x).sum(2)
        for m in range(parts):
            codes[m] = plain[m].argmin(1)
        along = sum(rx[m] - onto[m][rows, codes[m]] for m in range(parts))
        for _ in range(sweeps):
            for m in range(parts):
                others = along + onto[m][rows, codes[m]]  # the sum of all parts but for the word of this one
                codes[m] = (plain[m] + eta * (others[:, None] - onto[m]) ** 2).argmin(1)
                along = others - onto[m][rows, codes[m]]
        return np.ascontiguousarray(codes.T)

    def _update(self, vectors: np.ndarray, residuals: np.ndarray, codes: np.ndarray) -> None:
        """Each code word in turn to the minimum of the loss, a 2 x 2 system, the others fixed."""
        n, parts = codes.shape
        r, x = residuals.reshape(n, parts, PART), vectors.reshape(n, parts, PART)
        errors = r - self.words[np.arange(parts), codes]
        along = (errors * x).sum((1, 2))
        for m in range(parts):
            others = along - (errors[:, m] * x[:, m]).sum(1)
            for w in range(WORDS):
                at = codes[:, m] == w
                if at.sum() < PART:
                    continue
                u, v = x[at, m], r[at, m]
                a = np.eye(PART) * at.sum() + (self.eta - 1) * u.T @ u
                b = v.sum(0) + (self.eta - 1) * (u * (others[at] + (v * u).sum(1))[:, None]).sum(0)
                self.words[m, w] = np.linalg.solve(a, b)
            errors[:, m] = r[:, m] - self.words[m][codes[:, m]]
            along = others + (errors[:, m] * x[:, m]).sum(1)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): inner products of each query with every pair of code words."""
        parts = len(self.words)
        q = queries.reshape(len(queries), parts, PART)
        each = np.einsum("nmd,mwd->nmw", q, self.words.astype(np.float32))
        return (each[:, 1::2, :, None] + each[:, 0::2, None, :]).reshape(len(queries), parts // 2, WORDS * WORDS)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        """The code words that four-bit codes stand for, looked up part by part: what queries scan."""
        words = self.words.astype(np.float32)
        pairs = np.empty((len(packed), packed.shape[1], 2, PART), np.float32)
        for b in range(packed.shape[1]):
            pairs[:, b, 0] = words[2 * b][packed[:, b] & 15]
            pairs[:, b, 1] = words[2 * b + 1][packed[:, b] >> 4]
        return pairs.reshape(len(packed), -1)


def scaled(residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of length 1, and their lengths."""
    lengths = np.linalg.norm(residuals, axis=1)
    return residuals / np.where(lengths > 0, lengths, 1)[:, None], lengths.astype(np.float32)


def scan(tables: np.ndarray, packed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(queries, items): approximate inner products with the residuals, by table look-ups."""
    scores = np.zeros((len(tables), len(packed)), np.float32)
    for b in range(packed.shape[1]):
        scores += np.take(tables[:, b], packed[:, b], axis=1)
    return scores * lengths


#: Queries from which on a cell is scanned for all of them at once.
BLOCK_SCAN = 8


def scan_block(queries: np.ndarray, looked_up: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What :func:`scan` gives, for many queries: code words are looked up once, not their products with each query."""
    return queries @ looked_up.T * lengths


def search_region(
    q_ids: np.ndarray, q: np.ndarray, probed: np.ndarray, ids: np.ndarray, x: np.ndarray, cells: np.ndarray, packed: np.ndarray, lengths: np.ndarray,
    centres: np.ndarray, quantiser: Quantiser, k: int, candidates: int, block: int = 1024,
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the best k items of one region for each query, padded with -inf; the query itself is none of them.

    ``probed``: (query, cell) pairs as two rows. Items are in the order of their cells. The codes of
    each cell are scanned by the queries that probe it; of all cells together the best candidates
    are ranked exactly.
    """
    n, keep = len(q), candidates
    rough = np.full((n, keep), -np.inf, np.float32)
    chosen = np.zeros((n, keep), np.int32)
    starts = np.searchsorted(cells, np.unique(cells))
    by_cell = np.argsort(probed[1], kind="stable")
    asked_cells = probed[1][by_cell]
    for start, stop in zip(starts, [*starts[1:], len(cells)]):
        cell = cells[start]
        who = probed[0][by_cell[np.searchsorted(asked_cells, cell) : np.searchsorted(asked_cells, cell, "right")]]
        if not len(who):
            continue
        looked_up, few = quantiser.unpack(packed[start:stop]) if len(who) > BLOCK_SCAN else None, min(keep, stop - start)
        for i in range(0, len(who), block):
            asking = who[i : i + block]
            codes, long = packed[start:stop], lengths[start:stop]
            scores = scan(quantiser.tables(q[asking]), codes, long) if looked_up is None else scan_block(q[asking], looked_up, long)
            scores += (q[asking] @ centres[cell])[:, None]
            scores[q_ids[asking, None] == ids[None, start:stop]] = -np.inf
            best = np.argpartition(-scores, few - 1, axis=1)[:, :few] if few < stop - start else np.broadcast_to(np.arange(few), (len(asking), few))
            both = np.concatenate([rough[asking], np.take_along_axis(scores, best, 1)], 1)
            items = np.concatenate([chosen[asking], (best + start).astype(np.int32)], 1)
            top = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
            rough[asking], chosen[asking] = np.take_along_axis(both, top, 1), np.take_along_axis(items, top, 1)
    best_ids, best_scores = np.zeros((n, k), np.int64), np.full((n, k), -np.inf)
    for i in range(0, n, block):
        some, known = chosen[i : i + block], rough[i : i + block]
        single = np.einsum("nd,nkd->nk", q[i : i + block], x[some])
        single[np.isneginf(known)] = -np.inf
        few = min(2 * k + 1, keep)  # double precision decides among the best few
        pick = np.argpartition(-single, few - 1, axis=1)[:, :few]
        some, single = np.take_along_axis(some, pick, 1), np.take_along_axis(single, pick, 1)
        exact = np.matmul(x[some].astype(np.float64), q[i : i + block, :, None].astype(np.float64))[:, :, 0]
        exact[np.isneginf(single)] = -np.inf
        found = ids[some]
        order = np.lexsort((found, -exact), axis=1)[:, :k]
        width = order.shape[1]
        best_ids[i : i + block, :width] = np.take_along_axis(found, order, 1)
        best_scores[i : i + block, :width] = np.take_along_axis(exact, order, 1)
    return best_ids, best_scores


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def usable_vectors(vectors: DataFrame, key: str, embedding: str, dims: int) -> DataFrame:
    """(id, v): vectors of length 1 as bytes, of the rows with ``dims`` finite values that are not all zero; the first of repeated ids."""
    e = F.col(embedding)
    # The size is judged first: null, too short and too long embeddings have no sum to look at.
    good = (F.size(e) == dims) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    rows = vectors.where(F.col(key).isNotNull() & good).select(F.col(key).cast("bigint").alias("id"), e.cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            values = values / np.abs(values).max(1, keepdims=True)
            unit = (values / np.linalg.norm(values, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in unit], pa.binary())], ["id", "v"])

    return rows.mapInArrow(run, "id bigint, v binary")


def probes_needed(unit: DataFrame, centres: np.ndarray, k: int, dims: int, least: int) -> int:
    """Cells that a query has to scan, ``least`` or more, so that they hold :data:`TRIAL_RECALL` of all true neighbours.

    The neighbours of queries taken by a hash are found by brute force over the whole table, one
    pass of one matrix product a batch; each counts with the place of its cell in its query's order.
    """
    if least >= len(centres):
        return len(centres)
    trial = unit.withColumn("_h", F.xxhash64("id", F.lit(3))).orderBy("_h").limit(TRIAL_QUERIES).select("id", "v").toPandas()
    q_ids, q = trial["id"].to_numpy(), np.frombuffer(b"".join(trial["v"]), np.float32).reshape(-1, dims)
    asked = unit.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = asked.value
        minus, vectors = np.zeros((len(q), 0), np.float32), np.zeros((len(q), 0, dims), np.float32)  # the best of the task so far
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), dims)
            far = -(q @ x.T)
            far[q_ids[:, None] == ids[None]] = np.inf
            if k < len(ids):
                best = np.argpartition(far, k - 1, axis=1)[:, :k]
                far, near = np.take_along_axis(far, best, 1), x[best]
            else:
                near = np.broadcast_to(x, (len(q), *x.shape))
            minus, vectors = np.concatenate([minus, far], 1), np.concatenate([vectors, near], 1)
            best = np.argsort(minus, axis=1)[:, :k]
            minus, vectors = np.take_along_axis(minus, best, 1), np.take_along_axis(vectors, best[:, :, None], 1)
        columns = [pa.array(np.repeat(q_ids, minus.shape[1])), pa.array(minus.ravel().astype(np.float64)), pa.array([v.tobytes() for v in vectors.reshape(-1, dims)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["q", "minus", "v"])

    every = unit.mapInArrow(run, "q bigint, minus double, v binary").where(F.col("minus") < F.lit(float("inf")))
    best = every.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("minus", "v"))), 1, k).alias("best"))
    found = best.select("q", F.explode("best.v").alias("v")).toPandas()  # k rows a query
    place = {int(i): n for n, i in enumerate(q_ids)}
    queries = q[[place[int(i)] for i in found["q"]]]
    cells = nearest(np.frombuffer(b"".join(found["v"]), np.float32).reshape(-1, dims), centres)
    half, ranks = (centres**2).sum(1) / 2, np.zeros(len(found), np.int64)
    for i in range(0, len(found), 256):
        far = half - queries[i : i + 256] @ centres.T
        ranks[i : i + 256] = (far <= np.take_along_axis(far, cells[i : i + 256, None], 1)).sum(1)
    return max(least, int(np.sort(ranks)[int(np.ceil(TRIAL_RECALL * len(ranks))) - 1]))


def nearest_neighbours(vectors: DataFrame, k: int = 5, key: str = "id", embedding: str = "embedding", dims: int = 64, probes: int = PROBES, candidates: int = CANDIDATES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, neighbour, rank, similarity): the ``k`` most similar other vectors of every usable vector, by cosine.

    Approximate: a neighbour in a cell that isn't probed is missed. ``probes`` cells are scanned at
    least, and as many more as :func:`probes_needed` finds on the table itself (measured recall is
    in the README); every similarity given is exact. Null, zero, too short, too long and non-finite
    embeddings take no part, as neither query nor neighbour. Equal similarities are ranked by id.
    Fewer than k+1 usable vectors give all there are. An empty table gives no row. Ids must be unique.
    """
    spark = vectors.sparkSession
    unit = materialize(usable_vectors(vectors, key, embedding, dims))
    count = unit.count()
    cells = int(max(1, min(MOST_CELLS, count // cell_rows)))
    sample_rows = min(MOST_SAMPLE, max(SAMPLE_PER_CELL * cells, 4096))
    # A bounded sample by a hash of the id, the same at every run.
    sample = unit.withColumn("_h", F.xxhash64("id")).orderBy("_h").limit(sample_rows).select("v").toPandas()["v"]
    if not count:
        return spark.createDataFrame([], "id bigint, neighbour bigint, rank int, similarity double")
    points = np.frombuffer(b"".join(sample), np.float32).reshape(-1, dims)
    centres = kmeans_tree(points, min(cells, len(points)))
    # Neighbouring cells are numbered side by side, region by region.
    region = nearest(centres, kmeans(centres, max(1, len(centres) // REGION_CELLS)))
    order = np.argsort(region, kind="stable")
    centres, region = centres[order], region[order].astype(np.int32)
    residuals = points - centres[nearest(points, centres)]
    repeat = -(-WORDS // len(points))
    quantiser = Quantiser.fit(np.tile(points, (repeat, 1)), np.tile(scaled(residuals)[0], (repeat, 1)))
    probes = probes_needed(unit, centres, k, dims, min(probes, len(centres)))
    model = spark.sparkContext.broadcast((centres, region, quantiser))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, region, quantiser = model.value
        half = (centres**2).sum(1) / 2
        for batch in batches:
            x = matrix(batch.column(1), dims)
            near, probed = np.zeros(len(x), np.int32), np.zeros((len(x), probes), np.int32)
            for i in range(0, len(x), 1024):
                scores = x[i : i + 1024] @ centres.T
                scores -= half
                near[i : i + 1024] = scores.argmax(1)
                probed[i : i + 1024] = np.argpartition(-scores, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.arange(probes)
            residuals, lengths = scaled(x - centres[near])
            packed = quantiser.pack(quantiser.assign(x, residuals))
            codes = pa.array([p.tobytes() for p in packed], pa.binary())
            probed.sort(1)  # cells of one region are side by side
            flat, row = probed.ravel(), np.repeat(np.arange(len(x)), probes)
            fresh = np.append(True, (region[flat[1:]] != region[flat[:-1]]) | (row[1:] != row[:-1])) if len(flat) else np.zeros(0, bool)
            begins = np.flatnonzero(fresh)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(flat)).astype(np.int32)), pa.array(flat))
            structs = pa.StructArray.from_arrays([pa.array(region[flat[begins]]), lists], ["region", "cells"])
            asks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row[begins], minlength=len(x)))).astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region[near]), pa.array(near), codes, pa.array(lengths), asks], ["id", "v", "region", "cell", "code", "length", "asks"])

    indexed = materialize(unit.mapInArrow(index, "id bigint, v binary, region int, cell int, code binary, length float, asks array<struct<region: int, cells: array<int>>>"))
    release(unit)
    asking = indexed.select("id", "v", F.inline("asks"))
    # Large regions are cut, so that no task holds more than a chunk of each side whatever its region holds.
    items = indexed.groupBy("region").agg(F.count("*").alias("n"))
    asked = indexed.select(F.explode("asks.region").alias("region")).groupBy("region").agg(F.count("*").alias("m"))
    grid = F.broadcast(  # at most MOST_CELLS rows
        items.join(asked, "region").select("region", F.ceil(F.col("n") / ITEM_CHUNK).cast("int").alias("rows"), F.ceil(F.col("m") / QUERY_CHUNK).cast("int").alias("columns"))
    )
    chunk = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.select("id", "v", "code", "length", "cell", "region").join(grid, "region").withColumn("row", chunk("rows", 1)).withColumn("column", every("columns"))
    right = asking.join(grid, "region").withColumn("column", chunk("columns", 2)).withColumn("row", every("rows"))
    where = ["region", "row", "column"]

    def search(items: pa.Table, queries: pa.Table) -> pa.Table:
        centres, _, quantiser = model.value
        if not len(items) or not len(queries):
            return pa.table({"id": pa.array([], pa.int64()), "found": pa.array([], FOUND)})
        order = np.lexsort((items["id"].to_numpy(), items["cell"].to_numpy()))
        ids, cells, x = items["id"].to_numpy()[order], items["cell"].to_numpy()[order], matrix(items["v"], dims)[order]
        packed = np.frombuffer(b"".join(items["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        lengths = items["length"].to_numpy()[order]
        probed = queries["q_cells"].combine_chunks()
        pairs = np.stack([np.repeat(np.arange(len(queries)), probed.value_lengths().to_numpy()), probed.flatten().to_numpy()])
        best, scores = search_region(queries["q_id"].to_numpy(), matrix(queries["q_v"], dims), pairs, ids, x, cells, packed, lengths, centres, quantiser, k, max(candidates, k))
        found = ~np.isneginf(scores)
        values = pa.StructArray.from_arrays([pa.array(-scores[found]), pa.array(best[found])], ["minus", "id"])
        offsets = pa.array(np.append(0, np.cumsum(found.sum(1))).astype(np.int32))
        return pa.table({"id": queries["q_id"].combine_chunks(), "found": pa.ListArray.from_arrays(offsets, values)})

    asking = right.select([F.col(c).alias(f"q_{c}") for c in ("id", "v", "cells", *where)])
    scanned = left.select("id", "v", "code", "length", "cell", *where).groupBy(*where).cogroup(asking.groupBy([f"q_{c}" for c in where]))
    found = scanned.applyInArrow(search, "id bigint, found array<struct<minus: double, id: bigint>>")
    # A query has at most regions x chunks x k candidates.
    best = found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("best"))
    return (
        best.select(F.col("id").alias("id"), F.posexplode("best").alias("pos", "one"))
        .where(F.col("one.minus") < F.lit(float("inf")))
        .select("id", F.col("one.id").alias("neighbour"), (F.col("pos") + 1).alias("rank"), (-F.col("one.minus")).alias("similarity"))
    )


FOUND = pa.list_(pa.struct([("minus", pa.float64()), ("id", pa.int64())]))


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one at least is among the other's neighbours."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
