"""Trees that tasks grow by themselves against Spark's own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from underwright.operators import grown, models, selection, tuning
from underwright.session import materialise


@pytest.fixture(scope="module")
def rows(spark):
    """1,500 rows with numbers, small counts, flags and a constant; ids are null or come twice."""
    rng = np.random.RandomState(0)
    x = np.stack([rng.randn(1500), rng.randn(1500) ** 3, rng.randint(0, 7, 1500), rng.randint(0, 2, 1500), rng.rand(1500) < 0.1, np.zeros(1500)], 1).astype(float)
    label = x[:, 0] + 0.4 * x[:, 2] * x[:, 3] - x[:, 4] + rng.randn(1500) > 0.6
    made = spark.createDataFrame([(None if i % 97 == 0 else f"c{i // 2}", float(y), v.tolist()) for i, (y, v) in enumerate(zip(label, x))],
                                 "customer_id string, label double, a array<double>").repartition(3, "a")
    table = made.select("customer_id", "label", array_to_vector("a").alias("features"), F.expr("IF(label = 1, 0.75D, 1.5D)").alias("weight"), F.expr("IF(label = 1, 2.5D, 1D)").alias("pos_weight"))
    return materialise(table, "grown")



@pytest.mark.parametrize("depth", [3, 12])
def test_a_tree_on_all_rows_and_features_is_sparks_tree(spark, rows, depth):
    plain = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=depth).fit(rows)
    table = grown.binned(rows, "weight")
    x, label, weight, _ = grown.load(table)
    tree = grown.class_tree(x, label, weight, depth, x.shape[1], np.random.RandomState(0))
    assert len(x) == 1500 and len(tree["feature"]) == plain.numNodes
    expected = sorted(r["p"] for r in models.positive_scores(plain.transform(rows)).collect())
    assert sorted(grown.tree_scores(tree, x)) == pytest.approx(expected, abs=1e-12)


def test_a_large_forest_is_grown_by_tasks(spark, rows, monkeypatch):
    """The same kind of forest as Spark's, without a node on the driver, and the same again."""
    estimator = models.forest(40, 30)
    plain = estimator.fit(rows)
    monkeypatch.setattr(grown, "DRIVER_NODES", 1000)
    monkeypatch.setattr(type(estimator), "fit", None)
    monkeypatch.setattr(grown, "SCORE_ROWS", 400)
    fitted, again = (grown.fit(models.forest(40, 30), part) for part in (rows, rows.repartition(5)))
    trees = list(fitted.load())
    assert len(trees) == 40 and sum(len(t["feature"]) for t in trees) == pytest.approx(plain.totalNumNodes, rel=0.05)
    ours, theirs, rerun = (models.positive_scores(m.transform(rows)) for m in (fitted, plain, again))
    assert sorted(map(str, ours.collect())) == sorted(map(str, rerun.collect()))
    a, b = (np.array(sorted(r["p"] for r in s.collect())) for s in (ours, theirs))
    assert len(a) == 1500 and abs(a - b).max() < 0.06 and models.auc_of(ours) == pytest.approx(models.auc_of(theirs), abs=0.01)


def test_forests_that_the_driver_holds_stay_sparks(spark, rows):
    assert grown.on_driver(models.forest(200, 30), 9_600) and grown.on_driver(models.forest(200, 8), 10**9)
    assert not grown.on_driver(models.forest(200, 30), 57_600)
    assert type(grown.fit(models.forest(2, 3), rows)).__name__ == "RandomForestClassificationModel"


def test_selection_scores_a_large_forest_from_its_files(spark, monkeypatch):
    rows = spark.range(400).selectExpr("CAST(id AS STRING) AS customer_id", "CAST((id * 7) % 53 + (id % 3) * 20 > 45 AS INT) AS creditworthy", "CAST(id * 7 % 53 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b", "CAST(id % 2 AS DOUBLE) AS c")
    columns = ["a", "b", "c"]
    plain = {r["feature"]: r["importance"] for r in selection.permutation_select(rows, columns, trees=30, repeats=3).collect()}
    monkeypatch.setattr(grown, "DRIVER_NODES", 10)
    found = {r["feature"]: r["importance"] for r in selection.permutation_select(rows, columns, trees=30, repeats=3).collect()}
    assert sorted(found) == columns and all(found[c] == pytest.approx(plain[c], abs=0.05) for c in columns) and found["a"] > 0.1


def test_cuts_are_sparks():
    assert grown.edges_of(np.array([1.0, 2.0, 2.0, 5.0]), np.ones(4)).tolist() == [1.5, 3.5]
    cuts = grown.edges_of(np.arange(1000.0), np.ones(1000))
    assert len(cuts) == 31 and np.diff(cuts).min() > 29 and np.diff(cuts).max() < 34
    assert grown.edges_of(np.zeros(9), np.ones(9)).size == 0


@pytest.mark.parametrize("settings", [{}, {"weight": "pos_weight", "min_rows": 5}, {"depth": 2, "step": 0.3, "weight": "weight"}])
def test_boosted_trees_on_all_rows_and_features_are_sparks(spark, rows, settings):
    estimator = models.boosted(**{"rounds": 12, "depth": 3, **settings})
    marked = rows.selectExpr("*", "substr(customer_id, 4, 1) = '7' AS held").na.fill(False, ["held"])
    fitted = estimator.fit(marked.filter("NOT held"))
    expected = sorted(r["p"] for r in models.positive_scores(fitted.transform(marked.filter("held"))).collect())
    boost = grown.Boost.of(estimator)
    found = grown.boosted_scores(spark, [grown.binned(marked, boost.weight, "held")], [(0, boost)]).collect()
    assert len(found) > 100 and {r["task"] for r in found} == {0}
    assert sorted(r["p"] for r in found) == pytest.approx(expected, abs=1e-9)


def test_a_boosted_search_is_one_job_with_the_same_order(spark, rows, monkeypatch):
    folds = [rows.selectExpr("*", f"pmod(xxhash64(customer_id), 2) = {k} AS held") for k in range(2)]
    folds = [part.na.fill(False, ["held"]) for part in folds]
    candidates = [{"rounds": r, "depth": d, "subsample": s, "columns": c} for r, d, s, c in ((2, 1, 1.0, 1.0), (20, 3, 1.0, 1.0), (20, 3, 0.8, 0.8))]
    build = lambda c: models.boosted(weight="pos_weight", **c)
    by_one = {str(c): models.cross_validate_auc(folds, lambda: build(c))[0] for c in candidates}
    jobs = []
    real = grown.boosted_scores
    monkeypatch.setattr(grown, "boosted_scores", lambda spark, tables, tasks: jobs.append(len(tasks)) or real(spark, tables, tasks))
    found = tuning.search(folds, build, candidates)
    assert jobs == [6] and len(found.results) == 3 and found.results[-1][0] == candidates[0]
    assert all(auc == pytest.approx(by_one[str(c)], abs=2e-3 if c["subsample"] == 1.0 else 0.02) for c, auc in found.results)


def test_early_stopping_goes_on_round_by_round(spark, rows, monkeypatch):
    train, validation = rows.filter("customer_id NOT LIKE '%3'"), rows.filter("customer_id LIKE '%3'")
    monkeypatch.setattr(tuning, "SMALL_ROWS", 0)
    ours = tuning.early_stopping(train, validation, 60, 4, 5, 3, 0.3)
    monkeypatch.setattr(grown, "TASK_ROWS", 0)
    theirs = tuning.early_stopping(train, validation, 60, 4, 5, 3, 0.3)
    assert ours.pop("val_auc") == pytest.approx(theirs.pop("val_auc"), abs=1e-9) and ours == theirs and ours["best_iteration"] > 4


def test_compared_boosted_models_are_fitted_by_tasks(spark, clean, monkeypatch):
    rows = clean.selectExpr("*", "IF(pmod(xxhash64(customer_id), 4) = 0, 'validation', 'train') AS split")
    train, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    registry = {"Gradient Boosting": lambda: models.boosted(8, 2), "CatBoost": lambda: models.boosted(8, 2, weight="weight")}
    ours = {r["model"]: r for r in models.compare_models(spark, train, validation, registry, 2).collect()}
    monkeypatch.setattr(grown, "TASK_ROWS", 0)
    for r in models.compare_models(spark, train, validation, registry, 2).collect():
        assert r["status"] == "ok" and all(ours[r["model"]][c] == pytest.approx(r[c], abs=0.02) for c in ("cv_auc_mean", "cv_auc_std", "val_auc"))
