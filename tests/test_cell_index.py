"""The metric index of the nearest-neighbour join against brute force, and how many pairs it meets."""

from __future__ import annotations

import numpy as np
import pytest

from underwright.operators import cell_index
from underwright.operators.cell_index import Cells, build_index, distances
from underwright.operators.knn import knn_neighbours

NAMES = ["a", "b"]


def clusters(n: int, seed: int) -> np.ndarray:
    rng = np.random.RandomState(seed)
    centres = np.random.RandomState(0).uniform(-100, 100, (20, 2))
    return centres[rng.randint(20, size=n)] + rng.randn(n, 2)


def frame(spark, x: np.ndarray, first: int = 0):
    rows = [(first + i, *map(float, v), i % 2) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, y int")


def vectors(df):
    return df.selectExpr("id", "array(a, b) AS x", "CAST(y AS DOUBLE) AS label")


def brute(train: np.ndarray, queries: np.ndarray, k: int) -> list[list[int]]:
    d = distances(queries, train)
    return [sorted(range(len(train)), key=lambda j: (row[j], j))[:k] for row in d]


def found(df, first: int) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"] - first, []).append(r["neighbour"])
    return out


def test_index_equals_brute_force_and_leaves_cells_out(spark):
    t, q = clusters(2000, 1), np.concatenate((clusters(150, 2), np.random.RandomState(3).uniform(-300, 300, (50, 2))))
    index = build_index(vectors(frame(spark, t)), len(t), query_block=40, train_block=100)
    assert len(index.cells.pivots) == 44 and index.cells.rows.sum() == len(t)
    queries = vectors(frame(spark, q, 10_000)).select("id", "x")
    assert found(index.nearest(queries, 15), 10_000) == dict(enumerate(brute(t, q, 15)))

    placed = cell_index._placed(queries, index.cells.pivots)
    first = cell_index._best_of(index._meet(placed, 15, "bigint"), 15)
    own = sum(int(index.cells.rows[r["cell"]]) for r in placed.collect())
    more = sum(int(index.cells.rows[c]) for r in index.visits(placed, first, 15).collect() for c in r["cells"])
    assert own + more < 0.2 * len(t) * len(q)


@pytest.mark.parametrize("k", [1, 7, 500])
def test_copies_ties_and_few_rows(spark, k):
    """Half of the rows are one point, others lie on a grid with many equal distances; k may be more than there are rows."""
    grid = np.array([(i, j) for i in range(12) for j in range(12)], float)
    t = np.concatenate((np.zeros((144, 2)), grid))
    q = np.concatenate((grid[::7] + 0.5, np.zeros((3, 2)), [[1e6, -1e6]]))
    near = knn_neighbours(frame(spark, t), frame(spark, q, 1000), NAMES, "id", "y", k, 9, 25, 0)
    assert found(near, 1000) == dict(enumerate(brute(t, q, k)))


def test_empty_sides(spark):
    rows, none = frame(spark, clusters(30, 1)), frame(spark, np.zeros((0, 2)))
    assert knn_neighbours(none, rows, NAMES, "id", "y", 3, broadcast_cells=0).collect() == []
    assert knn_neighbours(rows, none, NAMES, "id", "y", 3, broadcast_cells=0).collect() == []


def test_visited_cells_hold_every_neighbour():
    """Without a bound from a cell, the figures of the cells alone must not rule out a neighbour."""
    t, q = clusters(400, 5), clusters(60, 6)
    pivots = t[:20]
    d = np.sqrt(distances(t, pivots))
    cell = d.argmin(axis=1)
    away = d[np.arange(len(t)), cell]
    rows = np.bincount(cell, minlength=20)
    low, high = (np.array([f(away[cell == c]) for c in range(20)]) for f in (np.min, np.max))
    seen = Cells(pivots, rows, low, high).visited(q, np.full(len(q), np.inf), 5)
    own = distances(q, pivots).argmin(axis=1)
    for i, near in enumerate(brute(t, q, 5)):
        assert all(seen[i, cell[j]] or cell[j] == own[i] for j in near)


@pytest.mark.parametrize("most", [0.0, 1.0])
def test_many_columns_meet_in_blocks(spark, monkeypatch, most):
    """With many columns few cells are left out; blocks of rows then meet once each, and give the same rows."""
    monkeypatch.setattr(cell_index, "MOST_VISITED", most)
    monkeypatch.setattr(cell_index, "BLOCK", 90)
    sizes, met = [], cell_index._met
    monkeypatch.setattr(cell_index, "_met", lambda visits, train, n, *rest: sizes.append(len(n)) or met(visits, train, n, *rest))
    t, q = np.random.RandomState(1).randn(400, 20), np.random.RandomState(2).randn(50, 20)
    t[:40] = t[0]
    rows = spark.createDataFrame([(i, v.tolist(), float(i % 2)) for i, v in enumerate(t)], "id long, x array<double>, label double")
    queries = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(q)], "id long, x array<double>")
    index = build_index(rows, len(t))
    assert found(index.nearest(queries, 15), 1000) == dict(enumerate(brute(t, q, 15)))
    assert len(sizes) == 2 and (sizes[1] == 1) == (most == 0)


def test_tables_beyond_a_few_numbers_take_the_index(spark, monkeypatch):
    """A broadcast table is met whole by every query, so its work is quadratic; 130,000 rows of 4 columns are too many for it."""
    from underwright.operators import knn

    monkeypatch.setattr(knn, "_mapped", None)
    train = spark.range(130_000).selectExpr("id", "id % 361 * 1D AS a", "id DIV 361 * 1D AS b", "0D AS c", "0D AS d", "id % 2 AS y")
    near = knn_neighbours(train, train.filter("id % 40000 = 7").drop("y"), ["a", "b", "c", "d"], "id", "y", 1)
    assert {(r["id"], r["neighbour"], r["distance2"]) for r in near.collect()} == {(i, i, 0.0) for i in range(7, 130_000, 40_000)}


@pytest.mark.parametrize("k", [1, 6, 90])
def test_slices_of_a_block_give_the_nearest_of_the_whole(monkeypatch, k):
    """With ties across the slices, and more neighbours than a slice has rows."""
    monkeypatch.setattr(cell_index, "SLICE", 40)
    t, q = np.random.RandomState(1).randint(0, 3, (130, 3)).astype(float), np.random.RandomState(2).randint(0, 3, (25, 3)).astype(float)
    at, distance = cell_index.nearest_by_slices(q, t, k, (t**2).sum(axis=1))
    assert at.tolist() == brute(t, q, k) and distance.shape == (25, k)


def test_blocks_write_few_rows(spark, monkeypatch):
    """Where all rows meet in blocks, no cells are written before, and rows are shuffled once per large block."""
    written, write = [], cell_index.materialise
    monkeypatch.setattr(cell_index, "MOST_VISITED", 0.0)
    monkeypatch.setattr(cell_index, "materialise", lambda df, label: written.append(label) or write(df, label))
    t, q = np.random.RandomState(1).randn(300, 20), np.random.RandomState(2).randn(40, 20)
    rows = spark.createDataFrame([(i, v.tolist(), float(i % 2)) for i, v in enumerate(t)], "id long, x array<double>, label double")
    queries = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(q)], "id long, x array<double>")
    index = build_index(rows, len(t))
    assert found(index.nearest(queries, 15), 1000) == dict(enumerate(brute(t, q, 15)))
    assert written == ["knn-train", "knn-queries", "knn-first"] and cell_index.BLOCK * cell_index.ROWS_A_QUERY >= 10 * cell_index.SLICE
