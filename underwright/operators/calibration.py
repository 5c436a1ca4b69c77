"""Calibration of scores: monotone steps by pooled neighbours, or two parameters on the log-odds.

Both start from the counts per distinct score, with scores rounded to ``digits`` decimals, so there are at most 10^digits + 1
of them whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwright.functions.scalars import number
from underwright.operators.metrics import score_counts
from underwright.session import materialise

DIGITS = 6
#: Scores are pooled within so many spans of [0, 1] first; then the lists of so many neighbouring spans are merged at once.
SPANS, MERGED = 1024, 32
BLOCK = "low double, high double, n long, good long"
#: Log-odds of scores stay within +- log(1 / TINY).
TINY = 1e-6
STEPS = 12


def rounded_counts(scores: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(p, n, good) per score of ``digits`` decimals; rows without score or label don't count."""
    counts = score_counts(scores.selectExpr("y", f"round(p, {digits}) AS p"))
    return counts.selectExpr("p", "n1 + n0 AS n", "n1 AS good")


# --- isotonic -------------------------------------------------------------------------------------


def pooled(blocks: Iterable[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """Blocks (low, high, n, good) in order of their scores, neighbours united until the shares of good ones rise.

    Pooling parts and then their results gives the same as pooling everything, so lists of blocks can be merged in any tree.
    """
    out: list[tuple[float, float, int, int]] = []
    for low, high, n, good in blocks:
        while out and out[-1][3] * n >= good * out[-1][2]:
            before = out.pop()
            low, n, good = before[0], n + before[2], good + before[3]
        out.append((low, high, n, good))
    return out


def _pool(blocks: pd.DataFrame) -> pd.DataFrame:
    rows = blocks.sort_values("low")[["low", "high", "n", "good"]].itertuples(index=False, name=None)
    merged = pd.DataFrame(pooled(rows), columns=["low", "high", "n", "good"])
    merged.insert(0, "span", blocks["span"].iloc[0])
    return merged


def isotonic_blocks(scores: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The isotonic fit as (low, high, n, good, calibrated): scores from ``low`` to ``high`` share one calibrated probability.

    Each task pools spans of scores; then the lists of neighbouring spans are merged, 32 at a time, until one is left. No scores give no blocks.
    """
    blocks = rounded_counts(scores, digits).selectExpr(f"CAST(least({SPANS - 1}, greatest(0, floor(p * {SPANS}))) AS INT) AS span", "p AS low", "p AS high", "n", "good")
    spans = SPANS
    while True:
        blocks = blocks.groupBy("span").applyInPandas(_pool, f"span int, {BLOCK}")
        if spans == 1:
            break
        blocks = blocks.withColumn("span", F.expr(f"CAST(span div {MERGED} AS INT)"))
        spans = -(-spans // MERGED)
    return blocks.select("low", "high", "n", "good", (F.col("good") / F.col("n")).alias("calibrated"))


def calibration_steps(blocks: DataFrame) -> list[tuple[float, float]]:
    """(low, calibrated) of the blocks in order; at most 10^digits + 1 rows."""
    return [(r["low"], r["calibrated"]) for r in blocks.select("low", "calibrated").orderBy("low").collect()]


def calibrated_by_steps(p: str, steps: Sequence[tuple[float, float]]) -> Column:
    """The calibrated probability of the last block that begins at or below p; below all blocks that of the first. Null stays null."""
    low, value = (np.array([s[k] for s in steps], dtype=float) for k in (0, 1))

    @F.pandas_udf("double")
    def looked_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            if not len(low):
                yield pd.Series(np.nan, index=x.index)
                continue
            at = np.clip(np.searchsorted(low, x.to_numpy(dtype=float), side="right") - 1, 0, len(low) - 1)
            yield pd.Series(np.where(x.isna(), np.nan, value[at]), index=x.index)

    return F.nanvl(looked_up(F.col(p)), F.lit(None).cast("double"))


def isotonic_calibrated(scores: DataFrame, fitted_on: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """``scores`` with ``p`` replaced by its isotonic calibration, fitted on ``fitted_on`` or on the scores themselves."""
    steps = calibration_steps(isotonic_blocks(scores if fitted_on is None else fitted_on, digits))
    rounded = scores.withColumn("p", F.expr(f"round(p, {digits})"))
    return rounded.withColumn("p", calibrated_by_steps("p", steps))


# --- Platt ----------------------------------------------------------------------------------------


def log_odds(p: str) -> str:
    return f"ln(greatest({number(TINY)}, least({p}, {number(1 - TINY)})) / (1D - greatest({number(TINY)}, least({p}, {number(1 - TINY)}))))"


def platt_fit(scores: DataFrame, steps: int = STEPS, digits: int = DIGITS) -> tuple[float, float] | None:
    """(a, b) so that sigmoid(a * log-odds + b) fits the labels; None without any.

    Newton steps from (1, 0), each one aggregate over the score counts. The labels are drawn in as Platt does,
    (good + 1) / (good + 2) for good rows and 1 / (bad + 2) for bad ones, so separable scores have a finite fit. A step whose matrix is
    singular, as with one distinct score, moves b alone.
    """
    counts = materialise(rounded_counts(scores, digits).selectExpr(f"{log_odds('p')} AS x", "CAST(good AS DOUBLE) AS n1", "CAST(n - good AS DOUBLE) AS n0"), "platt")
    total = counts.selectExpr("sum(n1) AS n1", "sum(n0) AS n0").first()
    if total["n1"] is None:
        return None
    high, low = (total["n1"] + 1) / (total["n1"] + 2), 1 / (total["n0"] + 2)
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = f"(1D / (1D + exp(-({number(a)} * x + {number(b)}))))"
        row = counts.selectExpr("x", "n1", "n0", f"{q} AS q").selectExpr(
            f"sum((n1 + n0) * q - n1 * {number(high)} - n0 * {number(low)}) AS gb", f"sum(((n1 + n0) * q - n1 * {number(high)} - n0 * {number(low)}) * x) AS ga",
            "sum((n1 + n0) * q * (1 - q)) AS hbb", "sum((n1 + n0) * q * (1 - q) * x) AS hab", "sum((n1 + n0) * q * (1 - q) * x * x) AS haa").first()
        determinant = row["haa"] * row["hbb"] - row["hab"] ** 2
        if determinant > 1e-9 * row["haa"] * row["hbb"]:
            a, b = a - (row["hbb"] * row["ga"] - row["hab"] * row["gb"]) / determinant, b - (row["haa"] * row["gb"] - row["hab"] * row["ga"]) / determinant
        elif row["hbb"] > 0:
            b -= row["gb"] / row["hbb"]
    return a, b


def platt_probability(a: float, b: float, p: str = "p") -> str:
    return f"(1D / (1D + exp(-({number(a)} * {log_odds(p)} + {number(b)}))))"


def platt_calibrated(scores: DataFrame, fitted_on: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """``scores`` with ``p`` replaced by its Platt calibration; unchanged where nothing could be fitted."""
    fit = platt_fit(scores if fitted_on is None else fitted_on, digits=digits)
    return scores if fit is None else scores.withColumn("p", F.expr(platt_probability(*fit)))


def calibration_report(scores: DataFrame, fitted_on: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """(method, brier, log_loss) of the scores as they are and after either calibration, 6 digits."""
    fitted_on = scores if fitted_on is None else fitted_on
    variants = {"none": scores, "isotonic": isotonic_calibrated(scores, fitted_on, digits), "platt": platt_calibrated(scores, fitted_on, digits)}
    out = None
    bounded = f"greatest({number(TINY)}, least(p, {number(1 - TINY)}))"
    for method, calibrated in variants.items():
        row = calibrated.filter("p IS NOT NULL AND y IS NOT NULL").selectExpr(
            f"'{method}' AS method", "round(avg((p - y) * (p - y)), 6) AS brier", f"round(-avg(y * ln({bounded}) + (1 - y) * ln(1 - {bounded})), 6) AS log_loss")
        out = row if out is None else out.unionByName(row)
    return out
