"""Reproducible defects for testing a cleaning job on real tables, and intercept calibration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from underwright.functions.ranking import hash_ranked
from underwright.functions.scalars import hash_fraction, name, number, sigmoid, text, with_exprs
from underwright.session import materialise
from underwright.sources.contract import ID

# Share of cells to blank per column.
MISSING_SHARES = {"monthly_income": 0.01, "savings_balance": 0.03, "credit_utilization_ratio": 0.02, "credit_score": 0.005}
OUTLIER_SHARE, OUTLIER_FACTOR = 0.004, 8.0
DUPLICATE_SHARE = 0.008
CALIBRATION_RANGE = (-10.0, 10.0)
CALIBRATION_BITS = 60
BITS_PER_PASS = 5


def inject_missing(df: DataFrame, shares: Mapping[str, float] | None = None, seed: int = 42, id_col: str = ID) -> DataFrame:
    """Blank a share of each column, chosen by a hash of (id, column)."""
    shares = MISSING_SHARES if shares is None else shares
    return with_exprs(df, {
        c: f"IF({hash_fraction(id_col, text(c), text(str(seed)))} < {number(share)}, NULL, {name(c)})"
        for c, share in shares.items() if c in df.columns})


def inject_outliers(df: DataFrame, column: str = "monthly_income", share: float = OUTLIER_SHARE,
                    factor: float = OUTLIER_FACTOR, seed: int = 42, id_col: str = ID) -> DataFrame:
    """Multiply an exact number of present values, the first ones in a seeded hash order."""
    count = max(1, int(df.count() * share))
    present = hash_ranked(df.filter(f"{name(column)} IS NOT NULL"), id_col, f"{seed}|outlier", rank="_rank")
    changed = with_exprs(present, {column: f"IF(_rank <= {count}, {name(column)} * {number(factor)}, {name(column)})"})
    return changed.select(*df.columns).unionByName(df.filter(f"{name(column)} IS NULL"))


def inject_duplicates(df: DataFrame, share: float = DUPLICATE_SHARE, seed: int = 42, id_col: str = ID) -> DataFrame:
    """Append copies of an exact number of rows, the first ones in a seeded hash order."""
    count = max(1, int(df.count() * share))
    chosen = hash_ranked(df, id_col, f"{seed}|duplicate", rank="_rank").filter(f"_rank <= {count}")
    return df.unionByName(chosen.select(*df.columns))


def calibrate_intercept(df: DataFrame, logit: str, target_rate: float) -> float:
    """Shift b for which the mean of sigmoid(logit + b) is the target rate.

    The interval is halved 60 times. One pass over the logits evaluates 31 shifts, which settles five
    halvings, so twelve passes do.
    """
    z = materialise(df.selectExpr(f"CAST({logit} AS DOUBLE) AS z").filter("z IS NOT NULL"), "logits")
    low, high = CALIBRATION_RANGE
    for _ in range(CALIBRATION_BITS // BITS_PER_PASS):
        cells = 2**BITS_PER_PASS
        shifts = [low + (high - low) * i / cells for i in range(1, cells)]
        means = z.selectExpr(*[f"avg({sigmoid(f'z + {number(b)}')}) AS m{i}" for i, b in enumerate(shifts)]).first()
        below = sum(1 for m in means if m is not None and m < target_rate)
        edges = [low, *shifts, high]
        low, high = edges[below], edges[below + 1]
        if low == high:
            break
    return (low + high) / 2
