"""Registry of the check queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from underwright.functions.scalars import name, rounded
from underwright.operators.cleaning import clean_applicants
from underwright.operators.features import engineer_features
from underwright.session import materialise
from underwright.sources.applicants import applicants
from underwright.sources.scorecard import score_variants, scored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return applicants(spark, sf)


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean_applicants(applicants(spark, sf))


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned rows, written once for queries that need several passes."""
    return materialise(cleaned(spark, sf), "cleaned")


def features(spark: SparkSession, sf: str) -> DataFrame:
    return engineer_features(cleaned(spark, sf))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(applicants(spark, sf))


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score_variants(scores(spark, sf))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that both engines show the same digits."""
    return df.selectExpr(*[
        f"{rounded(name(c), digits)} AS {name(c)}" if kind == "double" else name(c) for c, kind in df.dtypes])
