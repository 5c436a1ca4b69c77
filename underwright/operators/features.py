"""Domain features, computed from the row alone."""

from __future__ import annotations

from pyspark.sql import DataFrame

from underwright.functions.scalars import clip_null, flag, number, safe_div, text, with_exprs

# Upper credit score of each tier (inclusive).
CREDIT_TIERS = ((550, "Deep Subprime"), (650, "Subprime"), (750, "Near-Prime"))
TOP_CREDIT_TIER = "Prime"


def payment_consistency() -> str:
    late = clip_null("num_late_payments_12m / 12", 0, 1)
    defaults = clip_null("num_previous_defaults", 0, 5)
    return f"(1 - {late}) * (1 - 0.2D * {defaults})"


def income_stability() -> str:
    """Tenure as a share of ten years, reduced for the self-employed, zero without a job."""
    tenure = clip_null("coalesce(employment_years, 0D) / 10", 0, 1)
    return (f"CASE WHEN employment_status = 'Employed' THEN {tenure} "
            f"WHEN employment_status = 'Self-Employed' THEN 0.6D * {tenure} ELSE 0D END")


def credit_tier() -> str:
    steps = " ".join(f"WHEN credit_score <= {bound} THEN {text(label)}" for bound, label in CREDIT_TIERS)
    return f"CASE {steps} WHEN credit_score IS NOT NULL THEN {text(TOP_CREDIT_TIER)} END"


def _weighted(*parts: tuple[float, str]) -> str:
    return " + ".join(f"{number(weight)} * ({part})" for weight, part in parts)


# Features that read input columns only.
BASE_FEATURES = {
    "dti_ratio": safe_div("monthly_debt_payment", "monthly_income"),
    "loan_monthly_burden": safe_div(safe_div("loan_amount", "loan_term_months"), "monthly_income"),
    "savings_to_income": safe_div("savings_balance", "monthly_income"),
    "payment_consistency": payment_consistency(),
    "income_stability": income_stability(),
    "maxed_out_flag": flag("credit_utilization_ratio > 0.8D"),
    "credit_inquiry_density": safe_div("num_credit_inquiries_6m", "num_open_accounts + 1"),
    "has_delinquency_history": flag("num_late_payments_12m > 0 OR num_previous_defaults > 0"),
    "credit_tier": credit_tier(),
}
# Weighted indices on top of them; any missing part makes the index missing.
INDEX_FEATURES = {
    "financial_health_index": _weighted(
        (0.30, clip_null("savings_to_income", 0, 60) + " / 60"),
        (0.25, "1 - " + clip_null("dti_ratio", 0, 2) + " / 2"),
        (0.20, clip_null("payment_consistency", 0, 1)),
        (0.15, "1 - " + clip_null("credit_utilization_ratio", 0, 1)),
        (0.10, clip_null("income_stability", 0, 1)),
    ),
    "risk_index": _weighted(
        (0.30, clip_null("dti_ratio", 0, 2) + " / 2"),
        (0.25, clip_null("credit_utilization_ratio", 0, 1.5) + " / 1.5D"),
        (0.20, clip_null("num_late_payments_12m / 6", 0, 1)),
        (0.15, clip_null("num_previous_defaults / 3", 0, 1)),
        (0.10, clip_null("loan_monthly_burden", 0, 1)),
    ),
}
# Output order.
FEATURES = (
    "dti_ratio",
    "loan_monthly_burden",
    "savings_to_income",
    "payment_consistency",
    "income_stability",
    "maxed_out_flag",
    "credit_inquiry_density",
    "has_delinquency_history",
    "financial_health_index",
    "risk_index",
    "credit_tier",
)


def engineer_features(df: DataFrame) -> DataFrame:
    """Append all features after the input columns (two steps: ratios and flags, then the indices)."""
    inputs = df.columns
    return with_exprs(with_exprs(df, BASE_FEATURES), INDEX_FEATURES).select(*inputs, *FEATURES)
