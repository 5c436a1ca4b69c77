"""Cleaning, features and scalar expressions on tiny frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from underwright.functions import scalars as sc
from underwright.operators import cleaning, features, injection, transforms
from underwright.sources.contract import COLUMN_NAMES


def one(spark, expression: str):
    return spark.range(1).selectExpr(f"{expression} AS v").first()["v"]


def test_repeated_ids_keep_the_first_row(spark):
    df = spark.createDataFrame([(2, "a", 40.0), (1, "a", 30.0), (3, "b", 50.0)], "row_seq bigint, customer_id string, age double")
    rows = {r["customer_id"]: r["age"] for r in cleaning.clean_applicants(df).collect()}
    assert rows == {"a": 30.0, "b": 50.0}


def test_ids_without_row_order_keep_one_row(spark):
    df = spark.createDataFrame([("a", 40.0), ("a", 30.0), ("b", 50.0)], "customer_id string, age double")
    assert cleaning.clean_applicants(df).count() == 2


def test_input_is_not_changed(spark):
    df = spark.createDataFrame([("a", 10.0)], "customer_id string, age double")
    cleaning.clean_applicants(df)
    assert df.first()["age"] == 10.0


@pytest.mark.parametrize("score, expected", [(999.0, 850.0), (100.0, 300.0), (700.0, 700.0), (None, None)])
def test_score_is_clipped(spark, score, expected):
    df = spark.createDataFrame([("a", score)], "customer_id string, credit_score double")
    assert cleaning.clean_applicants(df).first()["credit_score"] == expected


def test_negative_money_is_missing(spark):
    df = spark.createDataFrame([("a", -5.0), ("b", 0.0)], "customer_id string, monthly_income double")
    assert {r[0]: r[1] for r in cleaning.clean_applicants(df).collect()} == {"a": None, "b": 0.0}


def test_change_log_adds_up(raw, clean):
    log = {r["rule"]: r["n"] for r in cleaning.clean_change_log(raw).collect()}
    assert log["rows_before"] == raw.count() and log["rows_after"] == clean.count()
    assert log["rows_before"] - log["duplicate_rows"] - log["duplicate_ids"] == log["rows_after"]


def test_features_are_appended_in_order(clean):
    assert features.engineer_features(clean).columns == [*COLUMN_NAMES, *features.FEATURES]


def test_dti_ratio_is_debt_over_income(clean):
    rows = features.engineer_features(clean).filter("monthly_income > 0 AND monthly_debt_payment IS NOT NULL").collect()
    assert rows and all(r["dti_ratio"] == r["monthly_debt_payment"] / r["monthly_income"] for r in rows)


def test_no_infinite_features(clean):
    numeric = [c for c, t in features.engineer_features(clean).dtypes if t == "double"]
    df = features.engineer_features(clean)
    assert df.filter(" OR ".join(f"abs({c}) = double('infinity') OR isnan({c})" for c in numeric)).count() == 0


@pytest.mark.parametrize("column", [c for c in COLUMN_NAMES if c not in ("row_seq", "customer_id", "creditworthy")])
def test_missing_input_never_gives_a_wrong_feature(clean, column):
    """A missing input makes a feature missing or leaves it as it is; flags stay 0 or 1."""
    blank = clean.withColumn(column, F.lit(None).cast(dict(clean.dtypes)[column]))
    rows = features.engineer_features(blank).select(*features.FEATURES).collect()
    assert all(r["maxed_out_flag"] in (0, 1) and r["has_delinquency_history"] in (0, 1) for r in rows)
    needs = {"monthly_income": ("dti_ratio", "risk_index", "financial_health_index"), "credit_score": ("credit_tier",),
             "credit_utilization_ratio": ("risk_index", "financial_health_index"), "num_late_payments_12m": ("payment_consistency",)}
    assert all(r[f] is None for f in needs.get(column, ()) for r in rows)


@pytest.mark.parametrize("score, tier", [(550, "Deep Subprime"), (551, "Subprime"), (650, "Subprime"), (750, "Near-Prime"),
                                         (751, "Prime"), (None, None)])
def test_credit_tier_bounds(spark, score, tier):
    df = spark.createDataFrame([(score,)], "credit_score double" if score is None else "credit_score int")
    assert df.selectExpr(f"{features.credit_tier()} AS t").first()["t"] == tier


def test_scalars(spark):
    assert one(spark, sc.safe_div("1D", "0D")) is None
    assert one(spark, sc.clip_null("CAST(NULL AS DOUBLE)", 0, 1)) is None
    assert one(spark, sc.clip_null("7D", 0, 1)) == 1.0
    assert one(spark, sc.flag("CAST(NULL AS DOUBLE) > 0")) == 0
    assert one(spark, sc.sigmoid("0D")) == 0.5
    assert one(spark, sc.log1p0("-3D")) == 0.0
    assert str(one(spark, sc.rounded("-0.0000001D"))) == "0.0"
    assert [one(spark, sc.risk_tier(f"{p}D")) for p in (0.049, 0.05, 0.15, 0.3)] == [
        "Low Risk", "Medium Risk", "High Risk", "Very High Risk"]
    assert one(spark, sc.odds_effect("0D")) == "decreases approval odds"


def test_nan_becomes_null(spark):
    df = sc.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert sorted(r[0] is None for r in df.collect()) == [False, True]


def test_zscore_of_a_constant_is_zero(spark):
    df = sc.zscore(spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double"), ["x"])
    assert [r["x_z"] for r in df.orderBy(F.desc("x")).collect()] == [0.0, 0.0, None]


def test_select_features_reports_unknown_names(clean):
    df, missing = cleaning.select_features(clean, ["age", "nope"])
    assert df.columns == ["age"] and missing == ["nope"]


def test_scaling_by_zero_spread(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "x double")
    assert transforms.fit_robust(df, {"x": "x"})["x"] == [3.0, 1.0]
    assert transforms.fit_standard(df, {"x": "x"})["x"] == [3.0, 1.0]


def test_mode_tie_takes_the_smallest():
    assert transforms.mode_of({"b": 2, "a": 2, "c": 1}) == "a"


def test_unseen_category_and_level(spark):
    hot = transforms.onehot("c", ["a", "b"])
    df = spark.createDataFrame([("z",)], "c string")
    assert list(df.selectExpr(*[f"{e} AS {k}" for k, e in hot.items()]).first()) == [0.0, 0.0]
    assert df.selectExpr(transforms.ordinal_education("c") + " AS e").first()["e"] == -1.0


def test_too_many_categories_is_an_error(spark):
    df = spark.range(transforms.MAX_CATEGORIES + 1).selectExpr("CAST(id AS STRING) AS c")
    with pytest.raises(ValueError):
        transforms.category_counts(df, ["c"])


def test_preprocess_depends_on_training_rows_only(clean):
    rows = features.engineer_features(clean)
    train = rows.filter("row_seq % 2 = 0")
    state = transforms.fit_preprocess(train)
    one_row = rows.filter("row_seq = 7")
    alone = transforms.apply_preprocess(one_row, state).collect()
    together = transforms.apply_preprocess(rows, state, ["row_seq"]).filter("row_seq = 7").drop("row_seq").collect()
    assert alone == together and not any(v is None for v in alone[0])


def test_injected_duplicates_and_outliers_have_exact_counts(clean):
    n = clean.count()
    assert injection.inject_duplicates(clean, 0.1).count() == n + int(n * 0.1)
    changed = injection.inject_outliers(clean, share=0.1).join(
        clean.selectExpr("customer_id", "monthly_income AS before"), "customer_id").filter("monthly_income != before")
    zero = clean.filter("monthly_income = 0").count()
    assert int(n * 0.1) - zero <= changed.count() <= int(n * 0.1)


def test_calibrated_intercept_hits_the_rate(clean):
    b = injection.calibrate_intercept(clean, "(credit_score - 600) / 100D", 0.7)
    rate = clean.selectExpr(f"avg({sc.sigmoid(f'(credit_score - 600) / 100D + {b!r}D')})").first()[0]
    assert rate == pytest.approx(0.7, abs=1e-9)
