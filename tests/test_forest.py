"""Forests keep the node of each row between levels and stay the same trees."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

from underwright.operators import models, selection


def shape(model) -> str:
    return model.toDebugString.split("\n", 1)[1]


def test_the_trees_are_those_of_the_plain_forest(spark):
    rows = spark.range(0, 400, numPartitions=3).selectExpr(
        "CAST(id % 37 AS DOUBLE) AS a", "CAST(id * 7 % 53 AS DOUBLE) AS b", "CAST(id % 5 AS DOUBLE) AS c",
        "CAST((id % 37) * 2 + id * 7 % 53 + (id * 31 % 17) > 70 AS DOUBLE) AS label", "IF(id % 3 = 0, 1.5D, 0.75D) AS weight")
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    plain = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=6, maxDepth=30, seed=42)
    fitted = models.forest(6, 30).fit(rows)
    assert fitted.totalNumNodes > 60 and shape(fitted) == shape(plain.fit(rows))


def test_every_forest_keeps_node_ids(spark, monkeypatch):
    assert models.model_registry(1)["Random Forest"]().getCacheNodeIds()

    class Called(Exception):
        pass

    def called(*args):
        raise Called(args)

    monkeypatch.setattr(selection, "forest", called)
    rows = spark.range(40).selectExpr("CAST(id AS STRING) AS customer_id", "CAST(id % 2 AS INT) AS creditworthy", "CAST(id AS DOUBLE) AS a")
    with pytest.raises(Called) as found:
        selection.permutation_select(rows, ["a"])
    assert found.value.args[0] == (200, 30, 42)
