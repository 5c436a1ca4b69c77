"""The steps of permutation importance that grow with rows x features x repeats."""

from __future__ import annotations

import bisect

from pyspark.sql import functions as F

from underwright.functions.scalars import with_exprs
from underwright.operators import explain, metrics
from underwright.session import spread


def test_scores_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def model(x):
        calls.add(1)
        return None if x is None else (x * 37 % 101) / 101

    rows = spark.createDataFrame([(i % 2, float(i), f"g{i % 3}") for i in range(300)] + [(1, None, "g0")], "y int, x double, g string")
    found = metrics.rank_metrics(rows.select("y", "g", model("x").alias("p")), ["g"]).collect()
    assert len(found) == 3 and calls.value == 301


def test_rows_without_score_or_label_do_not_count(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (None, 0.5), (1, None), (None, 0.7), (0, float("nan"))], "y int, p double")
    found = {str(r["p"]): (r["n1"], r["n0"]) for r in metrics.score_counts(rows).collect()}
    assert found == {"0.5": (1, 1), "nan": (0, 1)}


def test_bucket_is_the_number_of_quantiles_at_or_below(spark):
    scores = [i * i % 997 / 997 for i in range(4000)] + [0.25] * 900 + [float("inf"), float("-inf")]
    rows = spark.createDataFrame([(s,) for s in scores], "p double")
    shares = ", ".join(f"{k / metrics.BUCKETS!r}D" for k in range(1, metrics.BUCKETS))
    edges = rows.selectExpr(f"percentile_approx(p, array({shares}), {16 * metrics.BUCKETS}) AS e").first()["e"]
    for row in metrics._in_buckets(rows, "b").collect():
        assert row["b"] == bisect.bisect_right(edges, row["p"])


def test_packed_importance_is_the_same(spark):
    rows = spark.createDataFrame([(f"c{i}", int(i * 7 % 10 > 4), float(i % 10), float(i * 13 % 17), float(i % 3)) for i in range(200)],
                                 "customer_id string, y int, a double, b double, c double")
    wide = explain.permutation_importance(rows, ["a", "b", "c"], lambda df: with_exprs(df, {"p": "(a * 7 + b + c) / 100"}), 3)
    arrays = rows.selectExpr("customer_id", "y", "array(a, b, c) AS x")
    packed = explain.permutation_importance(arrays, ["a", "b", "c"], lambda df: with_exprs(df, {"p": "(x[0] * 7 + x[1] + x[2]) / 100"}), 3, packed="x")
    assert packed.collect() == wide.collect() and packed.count() == 3


def test_small_tables_are_dealt_over_all_cores(spark):
    rows = spark.range(100).coalesce(1)
    tasks = spread(rows, "id").select(F.spark_partition_id()).distinct().count()
    assert tasks > spark.sparkContext.defaultParallelism
