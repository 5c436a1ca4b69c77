"""Matrices of many rows are dealt evenly; fits side by side get few tasks; permuted rows cost one array each."""

from __future__ import annotations

import pytest
from pyspark.ml.feature import VectorAssembler

from catalog import models as queries
from underwright.operators import explain, models, selection, tuning
from underwright.session import dealt, spread


def sizes(df) -> list[int]:
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_dealt_rows_are_even_whole_and_in_order(spark):
    rows = spark.range(0, 4000, numPartitions=3).selectExpr("CAST(id AS STRING) AS customer_id", "id AS n")
    first = dealt(rows.filter("n < 3000").unionByName(rows.filter("n >= 3000")), 8, "customer_id", "dealt")
    again = dealt(rows.repartition(5), 8, "customer_id", "dealt")
    assert len(sizes(first)) == 8 and max(sizes(first)) < 1.5 * min(sizes(first))
    assert sorted(first.rdd.glom().map(lambda part: [tuple(r) for r in part]).collect()) == sorted(again.rdd.glom().map(lambda part: [tuple(r) for r in part]).collect())
    assert first.exceptAll(rows).isEmpty() and first.count() == 4000


@pytest.mark.parametrize("limit, parts", [(100, 8), (100_000, 1)])
def test_only_a_large_matrix_is_dealt(spark, monkeypatch, limit, parts):
    rows = spark.range(0, 2000, numPartitions=1).selectExpr("CAST(id AS STRING) AS customer_id", "CAST(id AS DOUBLE) AS x", "IF(id % 4 = 0, 'validation', 'train') AS split")
    monkeypatch.setattr(queries, "split_cleaned", lambda spark, sf: rows)
    monkeypatch.setattr(queries, "EVEN_ROWS", limit)
    monkeypatch.setattr(models, "Matrix", lambda *args: type("Same", (), {"transform": lambda self, df, keep: df})())
    _, train, validation = queries.matrices(spark, "")
    assert len(sizes(train)) == parts and (train.count(), validation.count()) == (1500, 500)


def test_boosted_search_gets_few_tasks_with_all_rows(spark, monkeypatch):
    folds = [spark.range(0, 300, numPartitions=6).selectExpr("CAST(id AS STRING) AS customer_id", f"id % 2 = {k} AS held") for k in range(2)]
    given = {}
    monkeypatch.setattr(tuning, "search", lambda folds, build, candidates: given.update(folds=folds, n=len(candidates)))
    tuning.random_search_boosted(folds)
    assert given["n"] == 30 and [len(sizes(f)) for f in given["folds"]] == [1, 1]
    assert all(new.exceptAll(old).isEmpty() and new.count() == 300 for old, new in zip(folds, given["folds"]))
    monkeypatch.setattr(tuning, "FIT_ROWS", 100)
    assert [len(sizes(f)) for f in tuning.fewer_tasks(folds)] == [3, 3]


def test_permutation_select_scores_arrays_with_the_same_result(spark, monkeypatch):
    rows = spark.range(0, 300, numPartitions=2).selectExpr(
        "CAST(id AS STRING) AS customer_id", "CAST((id * 7) % 53 + (id % 3) * 20 > 45 AS INT) AS creditworthy", "CAST(id * 7 % 53 AS DOUBLE) AS `a b`", "CAST(id % 3 AS INT) AS c", "id % 2 AS d")
    columns = ["a b", "c", "d"]
    seen, real = {}, explain.permutation_importance

    def wide(df, features, score, repeats, seed, packed=None, per_core=4):
        """The same with a column per feature."""
        seen.update(packed=packed, per_core=per_core)
        names = [f"x[{i}] AS `{c}`" for i, c in enumerate(features)]

        def arrays(part):
            assembled = VectorAssembler(inputCols=list(features), outputCol="_v").transform(part)
            return score(assembled.withColumn("x", selection.vector_to_array("_v")))

        return real(df.selectExpr("customer_id", "y", *names), features, arrays, repeats, seed)

    written, write = [], selection.materialise
    monkeypatch.setattr(selection, "materialise", lambda df, label: written.append(label) or write(df, label))
    plain = selection.permutation_select(rows, columns, trees=4, repeats=2, max_depth=5).collect()
    assert written == ["held", "scores", "scores"]
    monkeypatch.setattr(selection, "permutation_importance", wide)
    assert selection.permutation_select(rows, columns, trees=4, repeats=2, max_depth=5).collect() == plain
    assert seen == {"packed": "x", "per_core": 1} and plain[0]["importance"] > 0 and len(plain) == 3


def test_a_step_with_a_large_model_has_a_task_a_core(spark):
    assert spread(spark.range(100), "id", per_core=1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
