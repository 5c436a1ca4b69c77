"""Shared SQL texts of the check queries."""

from __future__ import annotations

import re
from pathlib import Path

_FIXTURES = (Path(__file__).resolve().parent.parent / "FIXTURES.md").read_text()
_BLOCKS = re.findall(r"```sql\n(.*?)```", _FIXTURES, re.S)
APPLICANTS = _BLOCKS[0].strip()
SCORED = _BLOCKS[1].strip()

NUMERIC = (
    "age", "dependents", "employment_years", "monthly_income", "monthly_expenses", "savings_balance", "total_assets",
    "monthly_debt_payment", "num_open_accounts", "num_credit_inquiries_6m", "num_late_payments_12m",
    "num_previous_defaults", "months_since_last_delinquency", "credit_utilization_ratio", "credit_score",
    "interest_rate", "loan_amount", "loan_term_months",
)
CATEGORICAL = ("gender", "marital_status", "education", "employment_status", "loan_purpose")
MONEY = ("monthly_income", "monthly_expenses", "savings_balance", "total_assets", "monthly_debt_payment", "loan_amount")
COLUMNS = (
    "row_seq", "customer_id", "age", "gender", "marital_status", "dependents", "education", "employment_status",
    "employment_years", "monthly_income", "monthly_expenses", "savings_balance", "total_assets",
    "monthly_debt_payment", "num_open_accounts", "num_credit_inquiries_6m", "num_late_payments_12m",
    "num_previous_defaults", "months_since_last_delinquency", "credit_utilization_ratio", "credit_score",
    "interest_rate", "loan_amount", "loan_term_months", "loan_purpose", "creditworthy",
)


def r(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0e0)"


def clip(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({lo}, least({x}, {hi})) END"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


CLEAN_RULES = {
    "age": "CASE WHEN age >= 18 THEN age END",
    "credit_score": clip("credit_score", "300e0", "850e0"),
    "credit_utilization_ratio": clip("credit_utilization_ratio", "0e0", "1.5e0"),
    "interest_rate": clip("interest_rate", "0e0", "40e0"),
    "loan_term_months": "CASE WHEN loan_term_months > 0 THEN loan_term_months END",
    **{c: f"CASE WHEN {c} >= 0 THEN {c} END" for c in MONEY},
    "dependents": "CASE WHEN dependents < 0 THEN 0e0 ELSE dependents END",
}
DEDUP = ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY row_seq) AS rn "
         "FROM applicants) WHERE rn = 1")
CLEANED = "SELECT " + ", ".join(
    f"{CLEAN_RULES[c]} AS {c}" if c in CLEAN_RULES else c for c in COLUMNS) + " FROM dedup"
RATIOS = {
    "dti_ratio": div("monthly_debt_payment", "monthly_income"),
    "loan_monthly_burden": div(div("loan_amount", "loan_term_months"), "monthly_income"),
    "savings_to_income": div("savings_balance", "monthly_income"),
    "payment_consistency": f"(1 - {clip('num_late_payments_12m / 12e0', '0e0', '1e0')}) "
                           f"* (1 - 0.2e0 * {clip('num_previous_defaults', '0e0', '5e0')})",
    "income_stability": "CASE WHEN employment_status = 'Employed' THEN greatest(0e0, least(coalesce(employment_years, 0e0) / 10e0, 1e0)) "
                        "WHEN employment_status = 'Self-Employed' THEN 0.6e0 * greatest(0e0, least(coalesce(employment_years, 0e0) / 10e0, 1e0)) "
                        "ELSE 0e0 END",
    "maxed_out_flag": "CASE WHEN credit_utilization_ratio > 0.8e0 THEN 1 ELSE 0 END",
    "credit_inquiry_density": div("num_credit_inquiries_6m", "num_open_accounts + 1"),
    "has_delinquency_history": "CASE WHEN num_late_payments_12m > 0 OR num_previous_defaults > 0 THEN 1 ELSE 0 END",
    "credit_tier": "CASE WHEN credit_score <= 550 THEN 'Deep Subprime' WHEN credit_score <= 650 THEN 'Subprime' "
                   "WHEN credit_score <= 750 THEN 'Near-Prime' WHEN credit_score IS NOT NULL THEN 'Prime' END",
}
COMPOSITES = {
    "financial_health_index":
        f"0.3e0 * ({clip('savings_to_income', '0e0', '60e0')}) / 60e0 + 0.25e0 * (1 - ({clip('dti_ratio', '0e0', '2e0')}) / 2e0) "
        f"+ 0.2e0 * ({clip('payment_consistency', '0e0', '1e0')}) + 0.15e0 * (1 - ({clip('credit_utilization_ratio', '0e0', '1e0')})) "
        f"+ 0.1e0 * ({clip('income_stability', '0e0', '1e0')})",
    "risk_index":
        f"0.3e0 * ({clip('dti_ratio', '0e0', '2e0')}) / 2e0 + 0.25e0 * ({clip('credit_utilization_ratio', '0e0', '1.5e0')}) / 1.5e0 "
        f"+ 0.2e0 * ({clip('num_late_payments_12m / 6e0', '0e0', '1e0')}) + 0.15e0 * ({clip('num_previous_defaults / 3e0', '0e0', '1e0')}) "
        f"+ 0.1e0 * ({clip('loan_monthly_burden', '0e0', '1e0')})",
}
FEATURE_NAMES = ("dti_ratio", "loan_monthly_burden", "savings_to_income", "payment_consistency", "income_stability",
                 "maxed_out_flag", "credit_inquiry_density", "has_delinquency_history", "financial_health_index",
                 "risk_index", "credit_tier")
FEATURES = ("SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in COMPOSITES.items()) + " FROM (SELECT *, "
            + ", ".join(f"{e} AS {n}" for n, e in RATIOS.items()) + " FROM cleaned)")
MODEL_SCORES = ("SELECT 'scorecard' AS model, customer_id, y, p FROM scored "
                "UNION ALL SELECT 'squared', customer_id, y, round(p * p, 6) FROM scored "
                "UNION ALL SELECT 'inverted', customer_id, y, round(1 - p, 6) FROM scored "
                "UNION ALL SELECT 'constant', customer_id, y, 0.5e0 FROM scored")
SCORED_RAW = SCORED.replace("round(1e0 / (", "(1e0 / (").replace(", 6) AS p", ") AS p")
CTES = {
    "applicants": (APPLICANTS, ()),
    "dedup": (DEDUP, ("applicants",)),
    "cleaned": (CLEANED, ("dedup",)),
    "features": (FEATURES, ("cleaned",)),
    "scored": (SCORED, ("applicants",)),
    "scored_raw": (SCORED_RAW, ("applicants",)),
    "model_scores": (MODEL_SCORES, ("scored",)),
}


def sql(select: str, *base: str, **extra: str) -> str:
    """``select`` with the named base tables (and their inputs) and extra CTEs in front."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][1]:
            need(other)
        if name not in needed:
            needed.append(name)

    for name in base:
        need(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in needed] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ", ".join(parts) + " " + select


def stacked(columns, template: str) -> str:
    """UNION ALL of ``template`` with {c} replaced by each column."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)
