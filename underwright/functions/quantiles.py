"""Exact interpolated quantiles of many columns at once.

An interval around each wanted rank is narrowed: every pass counts rows per sub-interval inside the tasks (Arrow
batches; ``HISTOGRAM_CELLS`` rows at most leave each) and keeps the sub-interval that holds the rank, until it contains a single value. All
columns and ranks share the passes, so the number of scans grows with the logarithm of the row count. No task holds
the values of a column, whatever the size of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.scalars import name, number

HISTOGRAM_CELLS = 65_536


def exact_quantiles(df: DataFrame, columns: Mapping[str, str] | Sequence[str],
                    probs: Sequence[float] | Mapping[str, Sequence[float]],
                    exact: bool = True) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles; missing values are skipped, an empty column gives None.

    ``columns`` are column names, or SQL expressions by result name. Infinite values count as the lowest or highest.
    ``exact=False`` takes Spark's one-pass approximate percentiles instead.
    """
    if not isinstance(columns, Mapping):
        columns = {c: name(c) for c in columns}
    wanted = {n: [float(q) for q in (probs[n] if isinstance(probs, Mapping) else probs)] for n in columns}
    names = list(columns)
    keys = {n: f"q{i}" for i, n in enumerate(names)}
    data = df.selectExpr(*[f"nanvl(CAST({columns[n]} AS DOUBLE), NULL) AS {keys[n]}" for n in names])
    if not exact:
        lists = {n: f"array({', '.join(map(number, wanted[n]))})" for n in names}
        row = data.selectExpr(*[f"percentile_approx({keys[n]}, {lists[n]}, 10000) AS {keys[n]}" for n in names]).first()
        return {n: list(row[keys[n]] or [None] * len(wanted[n])) for n in names}
    finite = f"{{k}} > {number(-math.inf)} AND {{k}} < {number(math.inf)}"
    spread = data.selectExpr(*[e for k in keys.values() for e in (
        f"count({k}) AS {k}_n", f"count_if({k} = {number(-math.inf)}) AS {k}_below", f"count_if({k} = {number(math.inf)}) AS {k}_above",
        f"min({k}) FILTER (WHERE {finite.format(k=k)}) AS {k}_lo", f"max({k}) FILTER (WHERE {finite.format(k=k)}) AS {k}_hi")]).first()
    ranks = {}
    for n in names:
        key = keys[n]
        size, below, above = (spread[f"{key}_{s}"] for s in ("n", "below", "above"))
        for q in wanted[n] if size else ():
            position = (size - 1) * q
            for rank in (math.floor(position), math.ceil(position)):
                if rank < below or rank >= size - above:
                    value = -math.inf if rank < below else math.inf
                    ranks[(key, rank)] = (value, value, 0)
                else:
                    ranks[(key, rank)] = (spread[f"{key}_lo"], spread[f"{key}_hi"], below)
    values = _values_at_ranks(data, ranks)
    out = {}
    for n in names:
        size = spread[f"{keys[n]}_n"]
        out[n] = []
        for q in wanted[n]:
            if not size:
                out[n].append(None)
                continue
            position = (size - 1) * q
            below = math.floor(position)
            low, high = values[(keys[n], below)], values[(keys[n], math.ceil(position))]
            share = position - below
            out[n].append(low if low == high else (1 - share) * low + share * high)
    return out


def _cell_counts(intervals: Sequence[tuple], cells: int):
    """Rows, lowest and highest value per cell of the intervals (column, low, high, rows below), added up over a whole task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(intervals), cells), np.int64)
        lowest, highest = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        for batch in batches:
            values = {c: batch.column(c).drop_null().to_numpy(zero_copy_only=False) for c in {interval[0] for interval in intervals}}
            for i, (column, low, high, _) in enumerate(intervals):
                x = values[column]
                x = x[(x >= low) & (x <= high)]
                half = 0.5 if high * 0.5 - low * 0.5 else 1.0  # halves can't overflow, but the smallest numbers have none
                cell = np.minimum((x * half - low * half) / (high * half - low * half) * cells, cells - 1).astype(np.int64)
                n[i] += np.bincount(cell, minlength=cells)
                np.minimum.at(lowest[i], cell, x)
                np.maximum.at(highest[i], cell, x)
        i, cell = np.nonzero(n)
        found = (i.astype(np.int32), cell.astype(np.int32), n[i, cell], lowest[i, cell], highest[i, cell])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["i", "cell", "n", "lo", "hi"])

    return counted


def _values_at_ranks(data: DataFrame, ranks: dict) -> dict:
    """Value at each 0-based (column, rank); ``ranks`` maps it to (low, high, rows below low)."""
    found = {}
    while True:
        found.update({k: lo for k, (lo, hi, _) in ranks.items() if lo == hi})
        ranks = {k: v for k, v in ranks.items() if k not in found}
        if not ranks:
            return found
        intervals = sorted({(column, *bounds) for (column, _), bounds in ranks.items()})
        cells = max(64, min(4096, HISTOGRAM_CELLS // len(intervals)))
        histogram = (
            data.mapInArrow(_cell_counts(intervals, cells), "i int, cell int, n long, lo double, hi double")
            .groupBy("i", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .collect()
        )
        by_interval: dict[int, list] = {}
        for r in histogram:
            by_interval.setdefault(r["i"], []).append((r["cell"], r["n"], r["lo"], r["hi"]))
        narrowed = {}
        for i, interval in enumerate(intervals):
            cumulative, steps = interval[3], []
            for _, n, lo, hi in sorted(by_interval[i]):
                steps.append((cumulative, cumulative + n, lo, hi))
                cumulative += n
            for (column, rank), bounds in ranks.items():
                if (column, *bounds) == interval:
                    start, _, lo, hi = next(s for s in steps if s[0] <= rank < s[1])
                    narrowed[(column, rank)] = (lo, hi, start)
        ranks = narrowed
