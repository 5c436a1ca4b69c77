"""Reproducible stratified splits by exact class counts in a seeded hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.ranking import hash_ranked
from underwright.functions.scalars import name
from underwright.sources.contract import ID, TARGET

SPLITS = ("train", "validation", "test")


def stratified_split(df: DataFrame, test_size: float = 0.2, val_size: float = 0.2, seed: int = 42,
                     id_col: str = ID, target: str = TARGET) -> DataFrame:
    """Append ``split``: test takes its share of each class, validation its share of the rest.

    Ranks come from hash buckets inside the class, so a class of any size stays spread over tasks.
    """
    ranked = hash_ranked(df, id_col, seed, [target], "_rank", size="_n").selectExpr("*", f"round(_n * {test_size}D) AS _test")
    split = (f"CASE WHEN _rank <= _test THEN 'test' WHEN _rank <= _test + round((_n - _test) * {val_size}D) THEN 'validation' "
             "ELSE 'train' END AS split")
    return ranked.selectExpr(*map(name, df.columns), split)


def holdout_80_20(df: DataFrame, seed: int = 42, id_col: str = ID, target: str = TARGET) -> DataFrame:
    """One split into train (80%) and test (20%)."""
    return stratified_split(df, 0.2, 0.0, seed, id_col, target)


def stratified_kfold(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = ID, target: str = TARGET) -> DataFrame:
    """Append ``fold`` in 0 .. k-1 with equal class shares."""
    ranked = hash_ranked(df, id_col, seed, [target], "_rank")
    return ranked.selectExpr(*map(name, df.columns), f"CAST((_rank - 1) % {k} AS INT) AS fold")


def split_report(split: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows, percent of all rows, class share and default rate per split."""
    counts = split.groupBy("split").agg(F.expr("count(*) AS n"), F.expr(f"avg({target}) AS share"))
    return counts.selectExpr("split", "n", "round(n * 100D / sum(n) OVER (), 2) AS pct_of_total",
                             "round(share, 4) AS class_1_share", "round(1 - share, 4) AS default_rate")
