"""Exact nearest neighbours by a metric index over the training rows.

Pivots drawn from the training rows cut the space into cells: a row is in the cell of its nearest pivot. A query first meets
its own cell, which gives a bound on the distance of its k-th neighbour. It then visits the other cells that can hold a row
within that bound. A cell is left out if its ring around its pivot is further away (triangle inequality), or
the half space of the points nearer to its pivot than to the query's. Large cells are cut into parts by a hash of the ids, so
a task meets a bounded number of queries and rows, whatever share of all rows one cell holds.

With many columns the bounds rule out few cells. Where the queries would visit more than ``MOST_VISITED`` of all pairs, blocks of
queries meet blocks of training rows instead, so a row is shuffled once per block and not once per visited cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.ranking import window
from underwright.session import materialise

#: There are as many pivots as the root of the number of training rows, and this many at most.
MOST_PIVOTS = 4096
QUERY_BLOCK = 2_000
TRAIN_BLOCK = 20_000
#: Share of all pairs beyond which whole blocks meet, the most and least queries of a block, and the training rows for each of them. A row is written
#: once per block of the other side, and a query leaves its best rows once per block, so large blocks keep the disk small.
MOST_VISITED, BLOCK, LEAST_BLOCK, ROWS_A_QUERY = 0.1, 100_000, 1_000, 2
#: Training rows that a query meets at once; a block has several of these.
SLICE = 20_000
#: Distances that a task holds at once (4 MB, so that they stay near the core).
DISTANCE_CELLS = 500_000
#: Pairs that a task meets, and the most tasks. Their number follows the work, as few bytes may mean many pairs.
TASK_PAIRS, MOST_TASKS = 50_000_000, 1_000
#: A cell is left out only if it is further away by this share, as distances are rounded.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, summed column by column."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def nearest(queries: np.ndarray, train: np.ndarray, k: int, squares: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances of the k nearest training rows of each query, nearest first, of equals the first.

    One matrix product gives distances with a small error. All rows that may be among the k best within that error are
    ranked again by the sum of squared differences. ``squares`` are the squared lengths of the training rows, where they are known.
    """
    squares = (train**2).sum(axis=1) if squares is None else squares
    own = (queries**2).sum(axis=1)
    rough = own[:, None] + squares - 2 * queries @ train.T
    error = 1e-12 * train.shape[1] * (own + squares.max())
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * error
    query, at = np.nonzero(rough <= limit[:, None])
    exact = np.empty(len(query))
    step = max(1, DISTANCE_CELLS // train.shape[1])
    for start in range(0, len(query), step):
        part = slice(start, start + step)
        exact[part] = ((queries[query[part]] - train[at[part]]) ** 2).sum(axis=1)
    order = np.lexsort((at, exact, query))
    first = np.searchsorted(query, np.arange(len(queries)))
    best = order[(first[:, None] + np.arange(k)).ravel()]
    return at[best].reshape(-1, k), exact[best].reshape(-1, k)


def nearest_by_slices(queries: np.ndarray, train: np.ndarray, k: int, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` with ``SLICE`` training rows at a time."""
    at, distance = nearest(queries, train[:SLICE], min(k, len(train), SLICE), squares[:SLICE])
    for start in range(SLICE, len(train), SLICE):
        part = slice(start, start + SLICE)
        more_at, more = nearest(queries, train[part], min(k, len(train[part])), squares[part])
        at, distance = np.hstack((at, more_at + start)), np.hstack((distance, more))
        order = distance.argsort(axis=1, kind="stable")[:, :k]  # of equals the first, as earlier slices stand before
        at, distance = np.take_along_axis(at, order, 1), np.take_along_axis(distance, order, 1)
    return at, distance


@dataclass(frozen=True)
class Cells:
    """Pivots, and for each cell the number of its training rows and their smallest and largest distance to the pivot."""

    pivots: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bound(self, to_pivots: np.ndarray, k: int) -> np.ndarray:
        """For each query a distance within which the cells alone prove ``k`` rows; infinite if there are fewer."""
        far = np.where(self.rows > 0, to_pivots + self.high, np.inf)
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.rows[order], axis=1) >= k
        at = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)
        return np.where(enough.any(axis=1), np.take_along_axis(far, at, axis=1)[:, 0], np.inf)

    def visited(self, x: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
        """Whether each query (row) has to visit each cell (column) but its own, given the distance of its k-th neighbour so far."""
        squared = distances(x, self.pivots)
        to_pivots = np.sqrt(squared)
        own = squared.argmin(axis=1)
        reach = np.minimum(reach, self.bound(to_pivots, k))[:, None]
        between = np.sqrt(distances(self.pivots[own], self.pivots))
        beside = (squared - squared[np.arange(len(x)), own][:, None]) / np.where(between > 0, 2 * between, np.inf)
        nearest = np.maximum(np.maximum(to_pivots - self.high, self.low - to_pivots), beside)
        out = (nearest <= reach + SLACK * (reach + to_pivots)) & (self.rows > 0)
        out[np.arange(len(x)), own] = False
        return out


def choose_pivots(train: DataFrame, n_train: int, most: int = MOST_PIVOTS) -> np.ndarray:
    """Different training rows with the smallest hashes of their ids, as many as the root of the row count, ``most`` at most."""
    wanted = min(most, max(1, math.isqrt(n_train)))
    share = min(1.0, (4 * wanted + 64) / n_train)
    # the hash cuts the sample before it is ordered, so no task reads more than some thousand rows
    cut = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    drawn = train.withColumn("h", F.xxhash64("id")).filter(f"h <= {cut}L").orderBy("h", "id").limit(wanted).select("x").toPandas()
    if drawn.empty:
        drawn = train.limit(1).select("x").toPandas()
    return np.unique(np.stack(drawn["x"]), axis=0)


def _placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows with the number of their cell and the distance to its pivot; of equally near pivots the first."""
    shipped = df.sparkSession.sparkContext.broadcast(pivots)
    fields = ", ".join(f"{c} {t}" for c, t in df.dtypes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = shipped.value
        step = max(1, DISTANCE_CELLS // len(points))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start:start + step]
                squared = distances(np.stack(part["x"]), points)
                cell = squared.argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), away=np.sqrt(squared[np.arange(len(part)), cell]))

    return df.mapInPandas(place, f"{fields}, cell int, away double")


def _met(visits: DataFrame, train: DataFrame, sizes: np.ndarray, k: int, kind: str, query_block: int, train_block: int) -> DataFrame:
    """The k nearest rows of each visited cell part for each visit (id, x, cell)."""
    spark = train.sparkSession
    n_visits = dict(visits.groupBy("cell").count().collect())
    parts = [(c, max(1, math.ceil(int(sizes[c]) / train_block)), max(1, math.ceil(n / query_block))) for c, n in n_visits.items()]
    tasks = min(MOST_TASKS, 1 + sum(int(sizes[c]) * n for c, n in n_visits.items()) // TASK_PAIRS)
    # one row per cell, so at most one per pivot
    parts = F.broadcast(spark.createDataFrame(parts, "cell int, t_parts int, q_parts int"))

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        return df.join(parts, "cell").selectExpr(*df.columns, f"CAST(pmod(xxhash64(id), {n_own}) AS INT) AS {own}",
                                                 f"explode(sequence(0, {n_other} - 1)) AS {other}")

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "label": [], "distance2": []})
        t = t.sort_values("id", ignore_index=True)
        tx, qx = np.stack(t["x"]), np.stack(q["x"])
        squares = (tx**2).sum(axis=1)
        take = min(k, len(t))
        out = []
        step = max(1, DISTANCE_CELLS // min(len(t), SLICE))
        for start in range(0, len(qx), step):
            at, distance = nearest_by_slices(qx[start:start + step], tx, take, squares)
            out.append(pd.DataFrame({
                "id": np.repeat(q["id"].to_numpy()[start:start + step], take), "neighbour": t["id"].to_numpy()[at].ravel(),
                "label": t["label"].to_numpy()[at].ravel(), "distance2": distance.ravel()}))
        return pd.concat(out, ignore_index=True)

    left = dealt(visits.select("id", "x", "cell"), "qp", "q_parts", "tp", "t_parts")
    right = dealt(train.select("id", "x", "label", "cell"), "tp", "t_parts", "qp", "q_parts")
    keys = ("cell", "tp", "qp")
    left, right = (side.repartition(tasks, *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"id {kind}, neighbour {kind}, label double, distance2 double")


def _best_of(candidates: DataFrame, k: int) -> DataFrame:
    ranked = candidates.selectExpr("*", f"row_number() {window(['id'], ['distance2', 'neighbour'])} AS rank")
    return ranked.filter(f"rank <= {k}")


@dataclass(frozen=True)
class Index:
    """Training rows (id, x, label) in their cells."""

    train: DataFrame
    cells: Cells
    query_block: int = QUERY_BLOCK
    train_block: int = TRAIN_BLOCK

    def visits(self, placed: DataFrame, first: DataFrame, k: int) -> DataFrame:
        """(id, x, cells): the further cells that each placed query visits, after the best rows ``first`` of its own cell."""
        kind = dict(placed.dtypes)["id"]
        return self._seen(placed, first, k, lambda part, seen: {"id": part["id"].to_numpy(), "x": part["x"].to_numpy(), "cells": [np.flatnonzero(row).astype(np.int32) for row in seen]},
                          f"id {kind}, x array<double>, cells array<int>")

    def _seen(self, placed: DataFrame, first: DataFrame, k: int, made: Callable[[pd.DataFrame, np.ndarray], dict], schema: str) -> DataFrame:
        """What ``made`` makes of some queries and the marks of the further cells that they visit."""
        shipped = placed.sparkSession.sparkContext.broadcast(self.cells)
        reach = first.groupBy("id").agg(F.expr(f"IF(count(*) >= {k}, sqrt(max(distance2)), NULL) AS reach"))

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells = shipped.value
            step = max(1, DISTANCE_CELLS // len(cells.rows))
            for batch in batches:
                for start in range(0, len(batch), step):
                    part = batch.iloc[start:start + step]
                    seen = cells.visited(np.stack(part["x"]), part["reach"].fillna(np.inf).to_numpy(float), k)
                    yield pd.DataFrame(made(part, seen))

        rows = placed.select("id", "x").join(reach, "id", "left")
        return rows.mapInPandas(visit, schema)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(id, neighbour, label, distance2, rank) of the k nearest training rows of each query (id, x); ties go to the lower id."""
        kind = dict(queries.dtypes)["id"]
        placed = materialise(_placed(queries.select("id", "x"), self.cells.pivots), "knn-queries")
        first = materialise(_best_of(self._meet(placed, k, kind), k).drop("rank"), "knn-first")
        if self.share(placed, first, k) > MOST_VISITED:
            return _best_of(self._blocks(placed, k, kind), k)
        visits = materialise(self.visits(placed, first, k), "knn-visits")
        more = self._meet(visits.selectExpr("id", "x", "explode(cells) AS cell"), k, kind)
        return _best_of(first.unionByName(more), k)

    def share(self, placed: DataFrame, first: DataFrame, k: int) -> float:
        """Share of all pairs of a query and a training row that the visits meet. Their cells aren't written for it, as they may be most of all."""
        sizes = self.cells.rows
        met, n = self._seen(placed, first, k, lambda part, seen: {"met": (seen @ sizes).astype(np.int64)}, "met bigint").agg(F.sum("met"), F.count("*")).first()
        return int(met or 0) / max(1, n * int(sizes.sum()))

    def _blocks(self, queries: DataFrame, k: int, kind: str) -> DataFrame:
        """The k nearest rows of each block of training rows for each query: all rows count as one cell, cut so that all cores have work."""
        one = F.lit(0).alias("cell")
        train = self.train.select("id", "x", "label", one)
        pairs = int(self.cells.rows.sum()) * queries.count()
        even = math.isqrt(pairs // (ROWS_A_QUERY * 4 * queries.sparkSession.sparkContext.defaultParallelism))
        block = min(BLOCK, max(LEAST_BLOCK, even))
        return _met(queries.select("id", "x", one), train, np.array([self.cells.rows.sum()]), k, kind, block, ROWS_A_QUERY * block)

    def _meet(self, visits: DataFrame, k: int, kind: str) -> DataFrame:
        return _met(visits, self.train, self.cells.rows, k, kind, self.query_block, self.train_block)


def build_index(train: DataFrame, n_train: int, query_block: int = QUERY_BLOCK, train_block: int = TRAIN_BLOCK,
                most_pivots: int = MOST_PIVOTS) -> Index:
    """Index of ``n_train`` > 0 training rows (id, x, label) without missing values.

    The driver holds the pivots and one row of figures per cell.
    """
    pivots = choose_pivots(train, n_train, most_pivots)
    placed = materialise(_placed(train, pivots), "knn-train")
    rows, low, high = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for cell, n, near, far in placed.groupBy("cell").agg(F.count("*"), F.min("away"), F.max("away")).collect():
        rows[cell], low[cell], high[cell] = n, near, far
    return Index(placed, Cells(pivots, rows, low, high), query_block, train_block)
