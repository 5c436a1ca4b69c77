"""Drift of the scores on a feed: a histogram per window as state, compared with a fixed reference when the window closes.

Each task of a micro-batch first adds its rows up to one partial histogram per window, so a window that most rows fall in isn't
one task's work. A window closes when a window has begun that starts ``delay`` after its end; rows of closed windows are late and not counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from underwright.functions.scalars import number
from underwright.operators.stability import BINS, LEAST_SHARE, MISSING, bin_counts, bin_edges, bin_index

PARTIAL = "window_end timestamp, counts array<bigint>"
DRIFT = "window_start timestamp, n bigint, psi double"


@dataclass(frozen=True)
class Reference:
    """Inner edges of the score bins and the counts of the reference, the missing ones first."""

    edges: tuple[float, ...]
    counts: tuple[int, ...]

    def psi(self, counts: Sequence[int]) -> float:
        """Population stability index of a histogram with the same bins, 6 digits."""
        expected, actual = (np.maximum(LEAST_SHARE, np.array(c) / max(1, sum(c))) for c in (self.counts, counts))
        return round(math.fsum((actual - expected) * np.log(actual / expected)), 6) + 0.0


def drift_reference(scores: DataFrame, bins: int = BINS) -> Reference:
    """Bins at the quantiles of the reference scores ``p``."""
    edges = bin_edges(scores, ["p"], bins)
    found = {r["bin"]: r["n"] for r in bin_counts(scores, edges).collect()}
    return Reference(tuple(edges["p"]), tuple(found.get(k, 0) for k in range(MISSING, len(edges["p"]) + 1)))


def _partials(edges: Sequence[float], width: int):
    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, step = len(edges) + 2, pd.Timedelta(minutes=width)
        for rows in batches:
            rows = rows[rows["ts"].notna()]
            place = np.where(rows["p"].isna(), 0, 1 + np.searchsorted(np.array(edges, dtype=float), rows["p"].to_numpy(dtype=float), side="left"))
            ends = rows["ts"].dt.floor(f"{width}min") + step
            cells = pd.crosstab(ends, place).reindex(columns=range(size), fill_value=0) if len(rows) else pd.DataFrame()
            yield pd.DataFrame({"window_end": cells.index, "counts": [list(map(int, c)) for c in cells.to_numpy()]})

    return add_up


def _keep_histogram(reference: Reference, width: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end = pd.Timestamp(key[0])
        if state.hasTimedOut:
            counts = state.get[0]
            state.remove()
            yield pd.DataFrame({"window_start": [end - pd.Timedelta(minutes=width)], "n": [sum(counts)], "psi": [reference.psi(counts)]})
            return
        counts = np.array(state.get[0] if state.exists else [0] * len(reference.counts))
        for rows in batches:
            for part in rows["counts"]:
                counts += np.array(part)
        state.update(([int(n) for n in counts],))
        state.setTimeoutTimestamp(int(end.value // 1_000_000))

    return update


def score_drift_stream(requests: DataFrame, reference: Reference, width: int = 60, delay: int = 10) -> DataFrame:
    """(window_start, n, psi) of each closed window of a stream of (ts, p); ``width`` and ``delay`` are minutes, the session's time zone UTC.

    Rows without time are no part of any window; rows without score fill the bin of missing ones. The state is one histogram per open
    window. Append mode; a query that is started again from its checkpoint goes on with the open windows.
    """
    partials = requests.select("ts", "p").mapInPandas(_partials(reference.edges, width), PARTIAL)
    timed = partials.withWatermark("window_end", f"{width + delay} minutes")
    return timed.groupBy("window_end").applyInPandasWithState(_keep_histogram(reference, width), DRIFT, "counts array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def score_drift(requests: DataFrame, reference: Reference, width: int = 60) -> DataFrame:
    """The same for all windows of a table of (ts, p)."""
    rows = requests.filter("ts IS NOT NULL").withColumn("w", F.window("ts", f"{width} minutes")["start"])
    cells = rows.selectExpr("w", f"{bin_index('p', reference.edges)} AS bin").groupBy("w", "bin").agg(F.count("*").alias("n"))
    found = cells.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("n"))
    total = max(1, sum(reference.counts))
    parts = [
        f"(greatest({number(LEAST_SHARE)}, coalesce(m[{k}], 0L) / n) - {number(e)}) * ln(greatest({number(LEAST_SHARE)}, coalesce(m[{k}], 0L) / n) / {number(e)})"
        for k, e in ((k, max(LEAST_SHARE, c / total)) for k, c in enumerate(reference.counts, MISSING))
    ]
    return found.selectExpr("w AS window_start", "n", f"round({' + '.join(parts)}, 6) + 0D AS psi")
