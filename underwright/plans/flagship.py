"""Flagship report: decisions and bad rates by credit tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwright.functions.scalars import with_exprs
from underwright.operators.cleaning import clean_applicants
from underwright.operators.features import engineer_features
from underwright.operators.scoring import score_applicants
from underwright.sources.applicants import applicants
from underwright.sources.scorecard import TERM_INPUTS, probability


def tier_summary(spark: SparkSession, sf_dir: str, threshold: float = 0.64) -> DataFrame:
    """Applicants, approvals and defaulters per credit tier and decision, in one plan."""
    rows = engineer_features(clean_applicants(applicants(spark, sf_dir)))
    decided = score_applicants(
        with_exprs(rows, {"p": probability(TERM_INPUTS)}), "p", threshold, ("credit_tier", "creditworthy", "p"))
    return (
        decided.groupBy("credit_tier", "decision")
        .agg(F.expr("count(*) AS n"), F.expr("round(avg(p), 4) AS mean_p"),
             F.expr("round(1 - avg(creditworthy), 4) AS bad_rate"))
        .orderBy("credit_tier", "decision")
    )
