"""Population stability: how far two tables, or an hour of a feed and a table, differ in their bins.

Bins are cut at quantiles of the first table. A bin's share counts as ``LEAST_SHARE`` at least, so an empty bin has a
defined part; missing values are a bin of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.quantiles import exact_quantiles
from underwright.functions.scalars import name, number, text

BINS = 10
LEAST_SHARE = 1e-4
MISSING = -1
# Below the first a population is stable, from the second on it has shifted.
STABLE, SHIFTED = 0.1, 0.25


def bin_edges(expected: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Inner edges per column: the different quantiles of the first table, none for an empty column."""
    found = exact_quantiles(expected, columns, [k / bins for k in range(1, bins)])
    return {c: sorted({q for q in found[c] if q is not None}) for c in columns}


def bin_index(column: str, edges: Sequence[float]) -> str:
    """Number of edges below a value, so bins hold their upper edge; missing values get -1."""
    below = f"size(filter(array({', '.join(map(number, edges))}), e -> {name(column)} > e))" if edges else "0"
    return f"CASE WHEN {name(column)} IS NULL THEN {MISSING} ELSE {below} END"


def bin_counts(df: DataFrame, edges: Mapping[str, Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, bin, n) of all columns in one pass; tasks add up before the shuffle."""
    cells = ", ".join(f"struct({text(c)} AS column, {bin_index(c, e)} AS bin)" for c, e in edges.items())
    return df.selectExpr(*by, f"explode(array({cells})) AS cell").groupBy(*by, "cell.column", "cell.bin").agg(F.count("*").alias("n"))


def share(n: str, total: str) -> str:
    return f"greatest({number(LEAST_SHARE)}, coalesce({n}, 0L) / nullif({total}, 0L))"


def stability_bins(expected: DataFrame, actual: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """Every bin of every column: column, bin, upper edge, both counts and shares, and its part of the index.

    Bins that neither table fills are there too. An empty table has the least share everywhere.
    """
    edges = bin_edges(expected, columns, bins)
    grid = [(c, k, edges[c][k] if 0 <= k < len(edges[c]) else None) for c in columns for k in range(MISSING, len(edges[c]) + 1)]
    cells = expected.sparkSession.createDataFrame(grid, "column string, bin int, upper double")
    for frame, n in ((expected, "expected_n"), (actual, "actual_n")):
        cells = cells.join(F.broadcast(bin_counts(frame, edges).withColumnRenamed("n", n)), ["column", "bin"], "left")  # a row per bin at most
    totals = {n: f"sum({n}) OVER (PARTITION BY column)" for n in ("expected_n", "actual_n")}
    shares = cells.selectExpr("*", *[f"{share(n, t)} AS {n[:-1]}share" for n, t in totals.items()])
    shares = shares.selectExpr("column", "bin", "upper", *[f"coalesce({n}, 0L) AS {n}" for n in totals], *[f"coalesce({n[:-1]}share, {number(LEAST_SHARE)}) AS {n[:-1]}share" for n in totals])
    return shares.selectExpr("*", "(actual_share - expected_share) * ln(actual_share / expected_share) AS part")


def population_stability(expected: DataFrame, actual: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """(column, n_bins, psi, verdict) with the largest index first; a bin of missing values counts."""
    verdict = f"CASE WHEN psi < {number(STABLE)} THEN 'stable' WHEN psi < {number(SHIFTED)} THEN 'moderate' ELSE 'shifted' END"
    index = stability_bins(expected, actual, columns, bins).groupBy("column").agg(F.count("*").cast("int").alias("n_bins"), F.expr("round(sum(part), 6) + 0D AS psi"))
    return index.selectExpr("column", "n_bins", "psi", f"{verdict} AS verdict").orderBy(F.desc("psi"), "column")
