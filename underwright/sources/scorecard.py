"""Fixed linear scorecard that gives reproducible scores on the applicant table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from underwright.functions.scalars import clip_null, number, sigmoid
from underwright.operators.cleaning import dedup_key
from underwright.operators.features import payment_consistency

INTERCEPT = 0.5
# Term, weight, centre. A missing term takes its centre.
TERMS = (("score", 0.006, 600.0), ("util", -2.0, 0.5), ("pc", 4.0, 0.9), ("dti", -1.0, 0.2))
TERM_NAMES = tuple(t for t, _, _ in TERMS)
TERM_INPUTS = {
    "score": f"coalesce({clip_null('credit_score', 300, 850)}, 600D)",
    "util": f"coalesce({clip_null('credit_utilization_ratio', 0, 1.5)}, 0.5D)",
    "pc": f"coalesce({payment_consistency()}, 0.9D)",
    "dti": "least(coalesce(CASE WHEN monthly_debt_payment >= 0 AND monthly_income > 0 "
           "THEN monthly_debt_payment / monthly_income END, 0.2D), 2D)",
}
SOURCE_COLUMNS = ("customer_id", "row_seq", "creditworthy", "credit_score", "credit_utilization_ratio",
                  "num_late_payments_12m", "num_previous_defaults", "monthly_debt_payment", "monthly_income")


def scorecard_inputs(df: DataFrame) -> DataFrame:
    """First row per applicant as (customer_id, row_seq, creditworthy, score, util, pc, dti), centres filled in."""
    return dedup_key(df.select(*SOURCE_COLUMNS)).selectExpr(
        "customer_id", "row_seq", "creditworthy", *[f"{e} AS {t}" for t, e in TERM_INPUTS.items()])


def term_contribution(term: str, value: str | None = None) -> str:
    """Weight times the distance of a term from its centre."""
    _, weight, centre = next(t for t in TERMS if t[0] == term)
    return f"({number(weight)} * ({value or term} - {number(centre)}))"


def margin(replace: Mapping[str, str] | None = None) -> str:
    """Log-odds of the scorecard; ``replace`` swaps term columns."""
    replace = replace or {}
    return " + ".join([number(INTERCEPT), *[term_contribution(t, replace.get(t)) for t in TERM_NAMES]])


def probability(replace: Mapping[str, str] | None = None, digits: int | None = 6) -> str:
    p = sigmoid(margin(replace))
    return p if digits is None else f"round({p}, {digits})"


def scored(df: DataFrame) -> DataFrame:
    """Score set (customer_id, y, p) with p rounded to six decimals."""
    return scorecard_inputs(df).selectExpr("customer_id", "creditworthy AS y", f"{probability()} AS p")


# Score columns of different quality, derived from one score.
VARIANTS = {"scorecard": "p", "squared": "round(p * p, 6)", "inverted": "round(1 - p, 6)", "constant": "0.5D"}


def score_variants(scores: DataFrame) -> DataFrame:
    """Several score columns as a long table (model, customer_id, y, p)."""
    entries = ", ".join(f"struct('{m}' AS model, {e} AS p)" for m, e in VARIANTS.items())
    return scores.selectExpr("customer_id", "y", f"explode(array({entries})) AS v").selectExpr(
        "v.model", "customer_id", "y", "v.p")
