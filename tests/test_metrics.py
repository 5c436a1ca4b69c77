"""Metric vectors, bounds and the order primitives on skewed input."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from underwright.functions.quantiles import exact_quantiles
from underwright.functions.ranking import hash_ranked, prefix_sum
from underwright.operators import metrics
from underwright.operators.splits import stratified_kfold, stratified_split

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def scores_of(spark, y, p):
    rows = [(f"i{i:05d}", int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "customer_id string, y int, p double")


@pytest.mark.parametrize("p, auc", [([0.1, 0.2, 0.8, 0.9], 1.0), ([0.9, 0.8, 0.2, 0.1], 0.0), ([0.5] * 4, 0.5)])
def test_auc_vectors(spark, p, auc):
    assert metrics.roc_auc(scores_of(spark, [0, 0, 1, 1], p)).first()["roc_auc"] == auc


def test_cost_of_one_error_each(spark):
    row = metrics.business_cost(scores_of(spark, [0, 0, 1, 1], [1, 0, 1, 0]), 0.5).first()
    assert (row["total_cost"], row["fp"], row["fn"], row["cost_per_applicant"]) == (6.0, 1, 1, 1.5)


def test_one_class_only(spark):
    row = metrics.metric_suite(scores_of(spark, [1, 1, 1], [0.2, 0.6, 0.9])).first()
    assert row["roc_auc"] is None and row["ks"] == 0.0 and row["specificity"] == 0.0 and row["tn"] == 0


def test_tied_costs_take_the_lowest_threshold(spark):
    row = metrics.optimal_threshold(scores_of(spark, [0, 1], [0.1, 0.9])).first()
    assert row["threshold"] == 0.11 and row["total_cost"] == 0.0


def brute_auc(y, p):
    good, bad = p[y == 1], p[y == 0]
    diff = good[:, None] - bad[None, :]
    return ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size


@FEW
@given(st.integers(0, 10_000))
def test_against_brute_force(spark, seed):
    rng = np.random.RandomState(seed)
    y = rng.randint(0, 2, 200)
    y[:2] = 0, 1
    # a third of the rows share one score
    p = np.where(rng.rand(200) < 0.33, 0.5, np.round(rng.rand(200), 2))
    frame = scores_of(spark, y, p)
    row = metrics.rank_metrics(frame).first()
    assert row["roc_auc"] == pytest.approx(brute_auc(y, p), abs=1e-6)
    assert row["brier"] == pytest.approx(np.mean((p - y) ** 2), abs=1e-6)
    flipped = metrics.rank_metrics(frame.selectExpr("customer_id", "y", "1 - p AS p")).first()
    assert flipped["roc_auc"] == pytest.approx(1 - row["roc_auc"], abs=2e-6)
    assert 0 <= row["ks"] <= 1
    lifts = {r["decile"]: r["lift"] for r in metrics.lift_deciles(frame).collect()}
    assert sorted(lifts) == list(range(1, 11)) and lifts[10] == 1.0 and all(0 <= v <= 10 for v in lifts.values())
    sweep = {r["threshold"]: (r["fp"], r["fn"]) for r in metrics.threshold_sweep(frame).collect()}
    for t in (0.01, 0.37, 0.5, 0.51, 0.99):
        assert sweep[t] == (int(((p >= t) & (y == 0)).sum()), int(((p < t) & (y == 1)).sum()))


@pytest.mark.parametrize("kind", ["spread", "hot", "constant", "extreme"])
def test_quantiles_by_narrowing_equal_the_sorted_ones(spark, kind):
    rng = np.random.RandomState(3)
    x = rng.lognormal(3, 2, 5000)
    if kind == "hot":
        x = np.where(rng.rand(5000) < 0.4, 7.0, x)
    if kind == "constant":
        x = np.full(5000, -2.5)
    if kind == "extreme":
        x[:3] = 1e300, -1e300, 5e-324
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([(float(v), None if i % 3 else float(-v)) for i, v in enumerate(x)], "x double, z double")
    found = exact_quantiles(df, ["x", "z"], probs)
    listed = ", ".join(f"{q}D" for q in probs)
    row = df.selectExpr(*[f"percentile({c}, array({listed})) AS {c}" for c in "xz"]).first()
    assert found == {c: list(row[c]) for c in "xz"}
    assert np.allclose(found["x"], np.quantile(x, probs), rtol=1e-12)
    assert np.allclose(found["z"], np.quantile(-x[::3], probs), rtol=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_quantiles_of_infinite_values(spark):
    low, high = float("-inf"), float("inf")
    rows = [(low, 1.0, high), (1.0, 2.0, high), (2.0, high, high), (3.0, high, high), (high, None, high)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    found = exact_quantiles(df, ["x", "y", "z"], [0.0, 0.25, 0.5, 1.0])
    assert found == {"x": [low, 1.0, 2.0, high], "y": [1.0, 1.75, high, high], "z": [high] * 4}


def test_quantiles_of_the_smallest_numbers(spark):
    df = spark.createDataFrame([(k * 5e-324,) for k in range(5)], "x double")
    assert exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 1.0]) == {"x": [0.0, 5e-324, 1e-323, 2e-323]}


def test_prefix_sum_by_buckets_equals_a_plain_running_sum(spark):
    df = spark.range(3000).selectExpr("id", "id % 7 AS g", "CAST(id / 100 AS INT) AS b0", "CAST(id / 10 AS INT) AS b1", "id AS v")
    rows = prefix_sum(df, {"s": "v"}, ["id"], ["b0", "b1"], ["g"]).collect()
    totals: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        totals[r["g"]] = totals.get(r["g"], 0) + r["v"]
        assert r["s"] == totals[r["g"]]


def test_hash_rank_is_a_permutation(spark):
    ranks = [r["rank"] for r in hash_ranked(spark.range(500), "id", 1).collect()]
    assert sorted(ranks) == list(range(1, 501))


def test_split_is_a_partition_with_equal_class_shares(clean):
    split = stratified_split(clean.select("customer_id", "creditworthy"))
    assert split.count() == clean.count()
    sizes = {(r["split"], r["creditworthy"]): r["count"] for r in split.groupBy("split", "creditworthy").count().collect()}
    for c in (0, 1):
        n = sum(v for (s, k), v in sizes.items() if k == c)
        assert abs(sizes[("test", c)] - 0.2 * n) <= 1 and abs(sizes[("validation", c)] - 0.16 * n) <= 1


def test_folds_are_balanced(clean):
    counts = [r["count"] for r in stratified_kfold(clean, 5).filter("creditworthy = 0").groupBy("fold").count().collect()]
    assert len(counts) == 5 and max(counts) - min(counts) <= 1
