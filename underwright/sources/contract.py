"""Applicant table layout and the input contract of the scoring step."""

from __future__ import annotations

from dataclasses import dataclass


ID = "customer_id"
ROW_SEQ = "row_seq"
TARGET = "creditworthy"
PROTECTED = ("gender", "marital_status")

# The raw applicant columns in table order, with their Spark types.
APPLICANT_COLUMNS = (
    ("row_seq", "bigint"),
    ("customer_id", "string"),
    ("age", "double"),
    ("gender", "string"),
    ("marital_status", "string"),
    ("dependents", "double"),
    ("education", "string"),
    ("employment_status", "string"),
    ("employment_years", "double"),
    ("monthly_income", "double"),
    ("monthly_expenses", "double"),
    ("savings_balance", "double"),
    ("total_assets", "double"),
    ("monthly_debt_payment", "double"),
    ("num_open_accounts", "double"),
    ("num_credit_inquiries_6m", "double"),
    ("num_late_payments_12m", "double"),
    ("num_previous_defaults", "double"),
    ("months_since_last_delinquency", "double"),
    ("credit_utilization_ratio", "double"),
    ("credit_score", "double"),
    ("interest_rate", "double"),
    ("loan_amount", "double"),
    ("loan_term_months", "double"),
    ("loan_purpose", "string"),
    ("creditworthy", "int"),
)
APPLICANT_DDL = ", ".join(f"{n} {t}" for n, t in APPLICANT_COLUMNS)
COLUMN_NAMES = tuple(n for n, _ in APPLICANT_COLUMNS)
NUMERIC = tuple(n for n, t in APPLICANT_COLUMNS if t == "double")
CATEGORICAL = tuple(n for n, t in APPLICANT_COLUMNS if t == "string" and n != ID)
MONEY = ("monthly_income", "monthly_expenses", "savings_balance", "total_assets", "monthly_debt_payment", "loan_amount")


@dataclass(frozen=True)
class FieldRule:
    """Allowed values of one model input."""

    feature: str
    kind: str
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple[str, ...] = ()
    nullable: bool = True


def _numeric(name: str, low: float | None, high: float | None = None) -> FieldRule:
    return FieldRule(name, "numeric", low, high)


def _categorical(name: str, *allowed: str) -> FieldRule:
    return FieldRule(name, "categorical", allowed=allowed)


EDUCATION_LEVELS = ("High School", "Bachelor", "Master", "Doctorate")

# The 21 model inputs in contract order, with ranges and allowed categories.
CONTRACT = (
    _numeric("age", 18, 100),
    _numeric("dependents", 0, 20),
    _categorical("education", *EDUCATION_LEVELS),
    _categorical("employment_status", "Employed", "Self-Employed", "Unemployed"),
    _numeric("employment_years", 0, 50),
    _numeric("monthly_income", 0),
    _numeric("monthly_expenses", 0),
    _numeric("savings_balance", 0),
    _numeric("total_assets", 0),
    _numeric("monthly_debt_payment", 0),
    _numeric("num_open_accounts", 0, 50),
    _numeric("num_credit_inquiries_6m", 0, 30),
    _numeric("num_late_payments_12m", 0, 12),
    _numeric("num_previous_defaults", 0, 10),
    _numeric("months_since_last_delinquency", 0, 120),
    _numeric("credit_utilization_ratio", 0, 1.5),
    _numeric("credit_score", 300, 850),
    _numeric("interest_rate", 0, 40),
    _numeric("loan_amount", 0),
    _numeric("loan_term_months", 6, 120),
    _categorical("loan_purpose", "Debt Consolidation", "Home", "Auto", "Education", "Personal", "Business", "Medical"),
)
MODEL_INPUTS = tuple(r.feature for r in CONTRACT)
