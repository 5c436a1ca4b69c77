"""The final fit transforms every row once, whatever the number of passes over the matrix and of metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from underwright.operators import models, tuning
from underwright.operators.splits import stratified_split
from underwright.session import materialise
from underwright.sources.contract import ID


def test_rows_are_transformed_once(spark, clean, monkeypatch):
    calls, transform = spark.sparkContext.accumulator(0), models.Matrix.transform

    @F.udf("boolean")
    def seen(key):
        calls.add(1)
        return True

    monkeypatch.setattr(models.Matrix, "transform", lambda self, df, keep=(): transform(self, df, keep).filter(seen(ID)))
    rows = materialise(stratified_split(clean), "split")
    parts = [rows.filter(f"split = '{s}'") for s in ("train", "validation", "test")]
    found = tuning.final_fit(*parts, selected=["credit_score", "dti_ratio", "num_late_payments_12m"])
    assert calls.value == rows.count()
    assert 0.5 < found["test"]["roc_auc"] <= 1 and 0 < found["threshold"] < 1
