"""Neighbours against brute force, the quantiser's loss, and rows that can't take part."""

import numpy as np
import pytest

from loomline.llm.nearest_vectors import Quantiser, nearest_neighbours, neighbour_pairs, scaled, scan


def clustered(n, seed=0, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    spread = rng.uniform(0.05, 0.9, 12)
    which = rng.choice(12, n, p=np.array([30, 20, 10, 10, 5, 5, 5, 5, 4, 3, 2, 1]) / 100)
    return (centres[which] + rng.normal(size=(n, dims)) * spread[which, None]) * rng.uniform(0.1, 20, (n, 1))


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = u @ u.T
    np.fill_diagonal(scores, -9)
    return np.argsort(-scores, axis=1)[:, :k], scores


def test_recall_and_exact_similarities(spark):
    x = clustered(3000)
    table = spark.createDataFrame([(i, [float(v) for v in row], "c") for i, row in enumerate(x)], "id bigint, embedding array<float>, rank string").repartition(5)
    found = nearest_neighbours(table, cell_rows=300).toPandas()
    top, scores = brute(x.astype(np.float32).astype(np.float64), 5)
    expected = {(i, int(j)) for i, row in enumerate(top) for j in row}
    got = set(zip(found["id"], found["neighbour"]))
    assert len(got & expected) / len(expected) >= 0.95 and len(got) == len(found) == 5 * len(x)
    assert np.allclose(found["similarity"], scores[found["id"], found["neighbour"]], atol=1e-5)
    assert (found["id"] != found["neighbour"]).all()


def test_recall_without_clusters_and_with_many_cells(spark):
    """The cells scanned follow from the table: 6 of 40 hold less than half of the neighbours here."""
    x = np.random.default_rng(8).normal(size=(4000, 64))
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, embedding array<float>").repartition(5)
    found = nearest_neighbours(table, cell_rows=100).toPandas()
    top, _ = brute(x.astype(np.float32).astype(np.float64), 5)
    expected = {(i, int(j)) for i, row in enumerate(top) for j in row}
    assert len(set(zip(found["id"], found["neighbour"])) & expected) / len(expected) >= 0.95


def test_rows_that_take_no_part(spark):
    one = [0.0] * 63 + [1.0]
    rows = [(1, one), (2, [2.0] * 64), (3, None), (4, [0.0] * 64), (5, [1.0] * 32), (6, [float("nan")] * 64), (7, [1.0] * 63 + [None]), (8, [float("inf")] * 64), (None, one), (9, [v * 3 for v in one])]
    table = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    found = nearest_neighbours(table).toPandas()
    assert sorted(set(found["id"])) == [1, 2, 9] and len(found) == 6
    first = found[found["rank"] == 1].set_index("id")["neighbour"]
    assert first[1] == 9 and first[9] == 1 and first[2] == 1
    pairs = {tuple(r) for r in neighbour_pairs(nearest_neighbours(table)).collect()}
    assert pairs == {(1, 2), (1, 9), (2, 9)}
    assert nearest_neighbours(table.limit(0)).count() == 0


def test_repeated_vectors(spark):
    rows = [(i, [1.0] * 64) for i in range(30)]
    found = nearest_neighbours(spark.createDataFrame(rows, "id bigint, embedding array<float>")).toPandas()
    assert len(found) == 150 and np.allclose(found["similarity"], 1)


def test_scores_are_worth_more_than_distance():
    """The score-aware codes have a smaller error along the vector than those by distance alone."""
    x = clustered(2000, 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    unit, _ = scaled(x - x.mean(0))
    aware, plain = Quantiser.fit(x, unit), Quantiser.fit(x, unit, eta=1.0)

    def along(q):
        codes = q.assign(x, unit)
        back = q.words[np.arange(len(q.words)), codes].reshape(unit.shape)
        return np.abs(((unit - back) * x).sum(1)).mean()

    assert along(aware) < along(plain)


def test_scan_is_the_inner_product_with_the_code_words():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    quantiser = Quantiser.fit(x, x)
    codes = quantiser.assign(x, x)
    back = quantiser.words[np.arange(32), codes].reshape(200, 64)
    queries = rng.normal(size=(7, 64)).astype(np.float32)
    got = scan(quantiser.tables(queries), quantiser.pack(codes), np.full(200, 2, np.float32))
    assert np.allclose(got, 2 * queries @ back.T, atol=1e-3)
    assert quantiser.pack(codes).shape == (200, 16) and pytest.approx(0) == 0
