"""Reports over decided applicants: gaps between protected groups, and the expected loss of a portfolio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.scalars import name, number, risk_tier

LEAST_GROUP = 30
#: An approval rate below this share of the best group's is marked.
FOUR_FIFTHS = 0.8
LOSS_GIVEN_DEFAULT = 0.45


def fairness_gaps(decided: DataFrame, groupings: Sequence[Sequence[str]], threshold: float = 0.5, least: int = LEAST_GROUP) -> DataFrame:
    """Approval and its gaps for every group of every grouping, from one pass with GROUPING SETS.

    ``decided`` has p, y and the group columns. Rows: grouping, the group columns (null where not grouped by, '(missing)' for missing
    values), n, n_good, approval_rate, true_positive_rate, adverse_impact_ratio (to the highest approval rate of the grouping), parity_difference and
    opportunity_difference (to the highest rates), below_four_fifths. Groups of under ``least`` rows are listed with their counts and
    rates, but neither set the highest rate nor get a ratio or difference; the same holds for true positives with under ``least`` good rows.
    """
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    approved = f"p >= {number(threshold)}"
    rows = decided.filter("p IS NOT NULL").selectExpr("p", "y", *[f"coalesce(CAST({name(c)} AS STRING), '(missing)') AS {name(c)}" for c in columns])
    grouped = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    counts = rows.groupingSets([[F.col(c) for c in g] for g in groupings], *columns).agg(
        grouped.alias("grouping"), F.count("*").alias("n"), F.expr(f"count_if({approved}) AS approved"), F.expr("count_if(y = 1) AS n_good"), F.expr(f"count_if(y = 1 AND {approved}) AS good_approved"))
    rates = counts.selectExpr(
        "*", "approved / n AS approval", "good_approved / nullif(n_good, 0) AS opportunity",
        f"CASE WHEN n >= {least} THEN approved / n END AS approval_ok", f"CASE WHEN n_good >= {least} THEN good_approved / n_good END AS opportunity_ok")
    best = rates.selectExpr("*", "max(approval_ok) OVER (PARTITION BY grouping) AS best_approval", "max(opportunity_ok) OVER (PARTITION BY grouping) AS best_opportunity")
    return best.selectExpr(
        "grouping", *map(name, columns), "n", "n_good", "round(approval, 6) AS approval_rate", "round(opportunity, 6) AS true_positive_rate",
        "round(approval_ok / nullif(best_approval, 0D), 6) AS adverse_impact_ratio", "round(approval_ok - best_approval, 6) + 0D AS parity_difference",
        "round(opportunity_ok - best_opportunity, 6) + 0D AS opportunity_difference", f"approval_ok / nullif(best_approval, 0D) < {number(FOUR_FIFTHS)} AS below_four_fifths")


def expected_loss(scores: DataFrame, exposure: str = "loan_amount", purpose: str = "loan_purpose", loss_given_default: float = LOSS_GIVEN_DEFAULT) -> DataFrame:
    """Exposure and expected loss by risk tier and purpose, by tier, and in all: a ROLLUP of exact decimal sums.

    ``scores`` has p, the exposure and the purpose. The loss of a row is (1 - p) x ``loss_given_default`` x exposure in whole
    cents. Rows: level ('total', 'tier', 'purpose'), risk_tier, loan_purpose (null above the level, '(missing)' for missing values), n, n_missing (rows without score or
    exposure, which count in n alone), exposure, expected_loss, loss_rate.
    """
    tier = risk_tier("(1D - p)")
    money = "CAST(floor({} * 100 + 0.5D) AS DECIMAL(18, 0)) * 0.01BD".format
    known = f"p IS NOT NULL AND {name(exposure)} IS NOT NULL"
    rows = scores.selectExpr(
        f"coalesce({tier}, '(missing)') AS risk_tier", f"coalesce(CAST({name(purpose)} AS STRING), '(missing)') AS loan_purpose", f"NOT ({known}) AS missing",
        f"CASE WHEN {known} THEN {money(name(exposure))} END AS exposure", f"CASE WHEN {known} THEN {money(f'(1D - p) * {number(loss_given_default)} * {name(exposure)}')} END AS loss")
    sums = rows.rollup("risk_tier", "loan_purpose").agg(
        F.grouping_id().alias("above"), F.count("*").alias("n"), F.expr("count_if(missing) AS n_missing"), F.coalesce(F.sum("exposure"), F.lit(0)).alias("exposure"), F.coalesce(F.sum("loss"), F.lit(0)).alias("expected_loss"))
    return sums.selectExpr(
        "CASE above WHEN 0 THEN 'purpose' WHEN 1 THEN 'tier' ELSE 'total' END AS level", "risk_tier", "loan_purpose", "n", "n_missing", "exposure", "expected_loss",
        "round(CAST(expected_loss AS DOUBLE) / nullif(CAST(exposure AS DOUBLE), 0D), 6) AS loss_rate")
