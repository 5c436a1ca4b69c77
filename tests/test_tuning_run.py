"""The tuning job goes on from its journal."""

from __future__ import annotations

import pytest

from underwright.operators import models, tuning
from underwright.plans.tuning import data_key, tuning_run

SMALL = [{"rounds": 2, "depth": 2, "step": 0.1, "subsample": 1.0, "columns": 1.0, "min_rows": 1}]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(tuning, "draw_boosted", lambda n, seed: SMALL[:n])
    monkeypatch.setattr(tuning, "C_FACTORS", (0.5, 1.0))


def test_a_lost_run_goes_on_and_a_second_fits_nothing(spark, clean, small, monkeypatch, tmp_path):
    path, real, calls = str(tmp_path / "journal"), models.cross_validate_auc, []

    def lost(folds, factory):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("driver lost")
        return real(folds, factory)

    monkeypatch.setattr(models, "cross_validate_auc", lost)
    with pytest.raises(RuntimeError):
        tuning_run(clean, path, 3, 1, folds=2)
    monkeypatch.setattr(models, "cross_validate_auc", real)

    # 3 draws of which 2 are known, 1 of the 2 grid values is the best draw, 1 boosted draw, 2 models
    first = tuning_run(clean, path, 3, 1, folds=2)
    assert first["fitted"] == 1 + 1 + 1 + 2
    rows = [tuple(r) for r in first["searches"].orderBy("model", "search", "rank").collect()]
    assert len(rows) == 3 + 2 + 1 and all(0.5 < r[4] <= 1 for r in rows)
    assert first["best"]["XGBoost"] == SMALL[0]

    monkeypatch.setattr(models, "cross_validate_auc", None)  # a second run must not get there
    again = tuning_run(clean, path, 3, 1, folds=2)
    assert again["fitted"] == 0 and again["best"] == first["best"]
    assert [tuple(r) for r in again["searches"].orderBy("model", "search", "rank").collect()] == rows
    held = again["matrix"].transform(clean)
    for model in ("Logistic Regression", "XGBoost"):
        p = [{r["customer_id"]: r["p"] for r in models.positive_scores(run["models"][model].transform(held)).collect()} for run in (first, again)]
        assert p[0].keys() == p[1].keys() and all(abs(p[0][k] - p[1][k]) < 1e-9 for k in p[0])


def test_data_key_sees_rows_not_their_order(spark, clean):
    key = data_key(clean)
    assert data_key(clean.orderBy("age").repartition(3)) == key
    assert data_key(clean.limit(clean.count() - 1)) != key
    assert data_key(clean.withColumn("age", clean.age + 1)) != key
    assert data_key(clean.unionByName(clean.limit(1)).unionByName(clean.limit(1))) != key
