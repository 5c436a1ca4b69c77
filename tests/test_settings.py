"""The check queries call the operators with the library's full settings."""

from __future__ import annotations

import inspect

import pytest
from conftest import SF

from catalog import all_queries
from catalog import models as queries
from catalog import selection as selection_queries
from underwright.operators import explain, models, selection, tuning


class Called(Exception):
    pass


@pytest.fixture
def settings(monkeypatch):
    """Arguments, with defaults, that a query gives to an operator; the operator itself doesn't run."""

    def of(query, module, operator):
        signature = inspect.signature(getattr(module, operator))

        def called(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            raise Called(bound.arguments)

        monkeypatch.setattr(module, operator, called)
        with pytest.raises(Called) as found:
            all_queries()[query](None, SF)
        return found.value.args[0]

    return of


def test_selection(settings, monkeypatch):
    monkeypatch.setattr(selection_queries, "matrix_rows", lambda spark, sf: (None, []))
    found = settings("permutation_select", selection, "permutation_select")
    assert (found["trees"], found["repeats"], found["max_depth"]) == (200, 5, 30)
    found = settings("run_selection", selection, "run_selection")
    assert (found["trees"], found["repeats"], found["rfe_step"], found["top_k"]) == (200, 5, 1, 25)


def test_partial_dependence_of_the_top_four(spark, monkeypatch):
    ranked = spark.createDataFrame([(f"f{i}", float(i % 7), 0.0) for i in range(7)], "feature string, importance double, deviation double")
    asked = {}
    monkeypatch.setattr(explain, "permutation_importance", lambda df, features, *a, **b: asked.update(features=features) or ranked)

    def called(df, features, score):
        raise Called(features)

    monkeypatch.setattr(explain, "partial_dependence", called)
    with pytest.raises(Called) as found:
        all_queries()["pdp_cross"](spark, "/root/testdata/sf0.001")
    assert found.value.args[0] == ["f6", "f5", "f4", "f3"] and len(asked["features"]) > 4


class Rows:
    """Stands for a table of 100 rows."""

    def filter(self, condition):
        return self

    def count(self):
        return 100


@pytest.fixture
def no_rows(monkeypatch):
    """Folds and searches without data; the folds are their number, the best C is 7."""
    rows = Rows()
    monkeypatch.setattr(queries, "split_cleaned", lambda spark, sf: rows)
    monkeypatch.setattr(queries, "matrices", lambda spark, sf: (None, rows, rows))
    monkeypatch.setattr(models, "fold_matrices", lambda rows, k: k)
    monkeypatch.setattr(tuning, "random_search_logistic", lambda folds, n: tuning.Search([({"c": 7.0}, 0.9)]))


def test_model_queries(spark, settings, no_rows):
    found = settings("early_stopping", tuning, "early_stopping")
    assert (found["max_rounds"], found["patience"], found["first_rounds"]) == (2000, 30, 100)
    found = settings("compare_models", models, "compare_models")
    assert set(found["models"]) == set(models.model_registry(1)) and len(found["models"]) == 10 and found["k"] == 5
    found = settings("grid_refine", tuning, "grid_refine")
    assert (found["folds"], found["best_c"]) == (5, 7.0)
    assert not settings("fit_final_pair", tuning, "final_pair")["best"]["XGBoost"]


def test_boosted_search(settings, no_rows):
    found = settings("random_search_boosted", tuning, "random_search_boosted")
    assert (found["folds"], found["n_iter"]) == (5, 30)


def test_before_after_takes_what_the_searches_find(spark, settings, no_rows, monkeypatch):
    monkeypatch.setattr(tuning, "grid_refine", lambda folds, n, c: tuning.Search([({"c": 2 * c}, 0.9)]))
    monkeypatch.setattr(tuning, "random_search_boosted", lambda folds: tuning.Search([(dict(tuning.draw_boosted(1)[0], rounds=400), 0.9)]))
    default, tuned = settings("before_after", tuning, "before_after")["pairs"]["XGBoost"]
    assert default.getMaxIter() == 100 and tuned.getMaxIter() == 400
