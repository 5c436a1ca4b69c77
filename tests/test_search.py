"""The logistic search ranks all candidates in one job."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from underwright.operators import models, tuning
from underwright.session import materialise


def test_one_ranking_equals_a_search_one_by_one(spark, monkeypatch):
    rng = np.random.RandomState(4)
    x = rng.randn(400, 3)
    y = (x[:, 0] + rng.randn(400) > 0).astype(float)
    rows = spark.createDataFrame([(i, float(y[i]), x[i].tolist(), 1.0 + i % 3) for i in range(400)], "customer_id long, label double, x array<double>, weight double")
    matrix = materialise(rows.withColumn("features", array_to_vector("x")).drop("x"), "search")
    folds = [matrix.selectExpr("*", f"customer_id % 2 = {k} AS held") for k in range(2)]
    candidates = [{"c": c} for c in (0.01, 1.0, 1.0)]
    ranked, real = [], tuning.rank_metrics
    monkeypatch.setattr(tuning, "rank_metrics", lambda *a: ranked.append(1) or real(*a))
    whole = tuning.search_logistic(folds, 200, candidates)
    single = tuning.search(folds, lambda c: models.logistic(200, c["c"], 3000), candidates)
    assert [r[0] for r in whole.results] == [r[0] for r in single.results] and len(ranked) == 1
    assert [r[1] for r in whole.results] == pytest.approx([r[1] for r in single.results], abs=1e-9)
