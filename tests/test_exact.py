"""Scores below a millionth, infinite values, ties and broken CSV lines."""

from __future__ import annotations

import pytest

from underwright.functions.scalars import number
from underwright.operators import injection, selection
from underwright.operators.metrics import confusion, gain_curve, metric_suite, rank_metrics, threshold_sweep
from underwright.operators.scoring import InvalidInputError
from underwright.plans.batch_scoring import card_score, csv_batch_score
from underwright.sources.contract import CONTRACT, ID


def test_tiny_scores_keep_their_order(spark):
    scores = spark.createDataFrame([(str(k), int(k > 2), k * 1e-8) for k in range(1, 5)], "customer_id string, y int, p double")
    row = rank_metrics(scores).first()
    assert (row["roc_auc"], row["ks"]) == (1.0, 1.0)
    assert [r["customer_id"] for r in gain_curve(scores).orderBy("rank").collect()] == ["1", "2", "3", "4"]


@pytest.mark.parametrize("p", [0.4999996, 0.5, 0.29, 0.57, 0.58])
def test_one_rule_at_the_threshold(spark, p):
    scores = spark.createDataFrame([(1, p), (0, p)], "y int, p double")
    for t in (0.29, 0.5, 0.57, 0.58):
        a, b = confusion(scores, t).first(), metric_suite(scores, t).first()
        c = threshold_sweep(scores).filter(f"abs(threshold - {t}) < 1e-9").first()
        assert a["tp"] == b["tp"] == c["tp"] == int(p >= t)


def test_infinite_literal(spark):
    assert spark.sql(f"SELECT {number(float('inf'))} > 1 AND {number(float('-inf'))} < 1 AS x").first()["x"]


def test_tie_drops_the_earlier_column(spark):
    pairs = spark.createDataFrame([("one", "two", -0.99)], "a string, b string, r double")
    both = spark.createDataFrame([("one", 0.5), ("two", 0.5)], "feature string, mi double")
    assert [r[0] for r in selection.redundancy_prune(pairs, both, both).collect()] == ["one"]


def test_outliers_keep_repeated_ids(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("c", None)], f"{ID} string, monthly_income double")
    assert injection.inject_outliers(rows, share=0.5).count() == 4


def _csv(path, spark, clean):
    rows = [{k: "" if v is None else str(v) for k, v in r.asDict().items()} for r in clean.select(ID, *[c.feature for c in CONTRACT]).limit(3).collect()]
    rows[1]["age"], rows[2]["age"] = "twenty", "999"
    names = list(rows[0])
    lines = [",".join(names), *(",".join(r[c] for c in names) for r in rows), "only,three,fields"]
    path.write_text("\n".join(lines) + "\n")
    return ", ".join(f"{c} string" if c == ID or next((r.kind for r in CONTRACT if r.feature == c), "") != "numeric" else f"{c} double" for c in names)


def test_csv_keeps_the_contract(spark, batch, tmp_path):
    source = tmp_path / "in.csv"
    ddl = _csv(source, spark, batch)
    with pytest.raises(InvalidInputError):
        csv_batch_score(spark, str(source), str(tmp_path / "out"), card_score, ddl=ddl)
    csv_batch_score(spark, str(source), str(tmp_path / "out"), card_score, ddl=ddl, rejects=str(tmp_path / "rejects"))
    good = spark.read.option("header", True).csv(str(tmp_path / "out"))
    bad = spark.read.option("header", True).csv(str(tmp_path / "rejects"))
    assert good.count() == 1 and bad.count() == 3
    found = " ".join(r["violations"] for r in bad.collect())
    assert "age not_numeric twenty" in found and "age above_maximum 999" in found and "unreadable line" in found
