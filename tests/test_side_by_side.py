"""All fits of a compared model run at once."""

from __future__ import annotations

import threading

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import VectorAssembler

from underwright.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    plain = spark.range(60).selectExpr("CAST(id AS STRING) AS customer_id", "CAST(id % 2 AS DOUBLE) AS label", "CAST((id * 7) % 11 + id % 2 AS DOUBLE) AS a", "id % 5 AS part")
    return VectorAssembler(inputCols=["a"], outputCol="features").transform(plain)


def test_all_fits_of_a_model_run_at_once(spark, rows, monkeypatch):
    folds = [rows.selectExpr("*", f"part = {i} AS held") for i in range(5)]
    monkeypatch.setattr(models, "fold_matrices", lambda *args: folds)
    monkeypatch.setattr(models, "Matrix", lambda *args: type("Same", (), {"transform": lambda self, df: df})())
    meet = threading.Barrier(6, timeout=30)

    class Meeting:
        def fit(self, part):
            meet.wait()
            return NaiveBayes(modelType="gaussian").fit(part)

    found = models.compare_models(spark, rows, rows, {"Meeting": Meeting}).collect()
    assert [(r["model"], r["status"]) for r in found] == [("Meeting", "ok")] and found[0]["cv_auc_mean"] is not None and found[0]["val_auc"] is not None
