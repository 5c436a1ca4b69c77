"""The full profile of an applicant table: every quality and exploratory table from one written copy."""

from __future__ import annotations

from pyspark.sql import DataFrame

from underwright.operators import eda, profiling
from underwright.session import materialise

DENSITY_COLUMNS = ("credit_score", "credit_utilization_ratio", "num_late_payments_12m", "monthly_income", "interest_rate")


def quality_report(df: DataFrame) -> dict[str, DataFrame]:
    """Tables of the data-quality report."""
    return {
        "overview": profiling.overview(df),
        "columns": profiling.column_profile(df),
        "missing": profiling.missing_report(df),
        "duplicates": profiling.duplicate_report(df),
        "categories": profiling.categorical_topn(df),
        "numbers": profiling.numeric_describe(df),
        "flags": profiling.dq_flags(df),
    }


def eda_suite(df: DataFrame) -> dict[str, DataFrame]:
    """Tables behind the exploratory figures; the input is written once and read by all of them."""
    rows = materialise(df, "eda")
    return {
        "target_balance": profiling.target_balance(rows),
        "class_histogram": eda.class_histogram(rows),
        "class_box_stats": eda.class_box_stats(rows),
        "class_density": eda.class_density(rows, [c for c in DENSITY_COLUMNS if c in rows.columns]),
        "correlation_matrix": eda.correlation_matrix(rows),
        "target_correlation": eda.target_correlation(rows),
        "crosstab": eda.crosstab(rows),
        "default_rate_by": eda.default_rate_by(rows),
        "category_extremes": eda.category_extremes(rows),
        "skew_kurtosis": eda.skew_kurtosis(rows),
        "iqr_outliers": eda.iqr_outliers(rows),
    }
