"""Exact nearest-neighbour vote.

The training rows are the classifier. Up to ``BROADCAST_CELLS`` numbers they are shipped once to every executor, and the
queries are mapped over them where they lie, without a shuffle. Larger training sets give the same rows through the cells of
``cell_index``, where a query meets only the cells that can hold one of its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.scalars import name
from underwright.operators.cell_index import DISTANCE_CELLS, QUERY_BLOCK, TRAIN_BLOCK, build_index, nearest

NEIGHBOURS = 15
#: Training matrices of up to so many numbers are broadcast. A query meets all of them there, so they are few.
BROADCAST_CELLS = 500_000


def _mapped(left: DataFrame, right: DataFrame, k: int, kind: str) -> DataFrame:
    """Neighbours of every query from broadcast training rows."""
    model = right.toPandas().sort_values("id", ignore_index=True)
    shipped = left.sparkSession.sparkContext.broadcast((model["id"].to_numpy(), np.stack(model["x"]), model["label"].to_numpy()))
    take = min(k, len(model))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x, labels = shipped.value
        step = max(1, DISTANCE_CELLS // len(ids))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start:start + step]
                at, distance = nearest(np.stack(part["x"]), x, take)
                yield pd.DataFrame({
                    "id": np.repeat(part["id"].to_numpy(), take), "neighbour": ids[at].ravel(), "label": labels[at].ravel(),
                    "distance2": distance.ravel(), "rank": np.tile(np.arange(1, take + 1, dtype=np.int32), len(part))})

    return left.mapInPandas(best, f"id {kind}, neighbour {kind}, label double, distance2 double, rank int")


def knn_neighbours(train: DataFrame, queries: DataFrame, columns: Sequence[str], id_col: str, label: str,
                   k: int = NEIGHBOURS, query_block: int = QUERY_BLOCK, train_block: int = TRAIN_BLOCK,
                   broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """The k nearest training rows of each query as (id, neighbour, label, distance2, rank); ties go to the lower id.

    Query ids are unique and no value is missing.
    """
    columns = list(columns)
    x = f"array({', '.join(f'CAST({name(c)} AS DOUBLE)' for c in columns)}) AS x"
    left = queries.selectExpr(f"{name(id_col)} AS id", x)
    right = train.selectExpr(f"{name(id_col)} AS id", x, f"CAST({name(label)} AS DOUBLE) AS label")
    kind = dict(left.dtypes)["id"]
    n_train = right.count()
    if 0 < n_train * len(columns) <= broadcast_cells:
        return _mapped(left, right, k, kind).withColumnRenamed("id", id_col)
    if n_train == 0:
        return left.sparkSession.createDataFrame([], f"{name(id_col)} {kind}, neighbour {kind}, label double, distance2 double, rank int")
    return build_index(right, n_train, query_block, train_block).nearest(left, k).withColumnRenamed("id", id_col)


def knn_vote(train: DataFrame, queries: DataFrame, columns: Sequence[str], id_col: str, label: str,
             k: int = NEIGHBOURS) -> DataFrame:
    """Share of good rows among the k nearest, as (id, p)."""
    near = knn_neighbours(train, queries, columns, id_col, label, k)
    return near.groupBy(id_col).agg(F.expr("avg(label) AS p"))
