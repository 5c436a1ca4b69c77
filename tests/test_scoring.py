"""Contract, edge inputs, throughput, files and streams."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from underwright.operators.scoring import (
    SCORE_COLUMNS, InvalidInputError, MissingColumnsError, reason_codes, reasons_long, unknown_category, validate,
)
from underwright.plans.batch_scoring import CARD_REASONS, card_score, csv_batch_score, predict_batch
from underwright.session import scratch_path
from underwright.sources import files
from underwright.sources.contract import MODEL_INPUTS
from underwright.streaming.scoring import applicant_stream, score_stream


def test_missing_column(batch):
    with pytest.raises(MissingColumnsError):
        predict_batch(batch.drop("credit_score"), card_score)


def test_text_in_a_number(batch):
    with pytest.raises(InvalidInputError, match="'age' not_numeric: twenty"):
        predict_batch(batch.withColumn("age", F.lit("twenty")), card_score)


def test_out_of_range(batch):
    with pytest.raises(InvalidInputError, match="credit_score"):
        predict_batch(batch.withColumn("credit_score", F.lit(999.0)), card_score)


def test_unknown_category_is_scored(batch):
    odd = batch.withColumn("loan_purpose", F.lit("Space Travel"))
    assert predict_batch(odd, card_score)[0].count() == batch.count()
    assert unknown_category(odd).count() == batch.count()


def test_output_columns_and_values(batch):
    out = predict_batch(batch, card_score)[0]
    assert out.columns == ["customer_id", *SCORE_COLUMNS]
    for r in out.collect():
        assert 0 <= r["p_creditworthy"] <= 1 and abs(r["p_creditworthy"] + r["p_default"] - 1) < 2e-4
        assert r["decision"] in ("Approve", "Reject")


def test_reasons(batch):
    out = predict_batch(batch, card_score, reasons=CARD_REASONS, top_k=3)[0]
    rows = reasons_long(out).collect()
    assert len(rows) == 3 * batch.count()
    assert all((r["contribution"] >= 0) == (r["direction"] == "favor approval") for r in rows)
    assert batch.selectExpr(f"size({reason_codes({})}) AS n").distinct().first()["n"] == 0


def test_lenient_validation_splits_the_batch(raw):
    valid, rejected = validate(raw, strict=False)
    assert valid.count() + rejected.count() == raw.count() and rejected.count() > 0
    assert rejected.filter("size(violations) = 0").count() == 0


def test_one_row_no_row_all_missing_and_extra_column(batch):
    assert predict_batch(batch.limit(1), card_score)[0].count() == 1
    empty = predict_batch(batch.limit(0), card_score)[0]
    assert empty.count() == 0 and empty.columns[1:] == list(SCORE_COLUMNS)
    types = dict(batch.dtypes)
    blank = batch.withColumns({c: F.lit(None).cast(types[c]) for c in MODEL_INPUTS})
    assert predict_batch(blank, card_score)[0].filter("p_creditworthy IS NULL").count() == 0
    assert predict_batch(batch.withColumn("extra", F.lit(1)), card_score)[0].count() == batch.count()


def test_extreme_values(batch):
    rich = batch.withColumns({"monthly_income": F.lit(1e7), "loan_amount": F.lit(5e7)})
    assert predict_batch(rich, card_score)[0].count() == batch.count()


def test_throughput(spark, batch):
    many = batch.crossJoin(spark.range(20)).drop("id")
    predict_batch(many, card_score)[0].collect()
    start = time.perf_counter()
    assert len(predict_batch(many, card_score)[0].collect()) == 20 * batch.count()
    assert time.perf_counter() - start < 5


def test_csv_keeps_corrupt_lines_apart(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,x\noops,y\n")
    rows = files.scan_csv(spark, str(path), "a int, b string", keep_corrupt=True).collect()
    assert [r[files.CORRUPT] for r in rows] == [None, "oops,y"]


def test_csv_batch(spark, batch, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    files.sink_csv(batch, source)
    csv_batch_score(spark, source, target, card_score)
    assert spark.read.option("header", True).csv(target).count() == batch.count()


def test_json_artifact_round_trip(spark, tmp_path):
    value = {"C": 0.2157, "features": ["a", "b"]}
    files.write_json(spark, value, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j")) == value


def test_missing_model_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_model(spark, str(tmp_path / "none"))


def test_stream_equals_batch(spark, raw):
    feed, decisions, rejects, checkpoint = (scratch_path(spark, k) for k in ("f", "d", "r", "c"))
    raw.repartition(3).write.parquet(feed)
    keep = ("row_seq", "customer_id")
    ddl = ", ".join(f"{c} {t}" for c, t in raw.dtypes)
    score_stream(applicant_stream(spark, feed, ddl, 1), card_score, decisions, rejects, checkpoint, keep=keep).awaitTermination()
    streamed = spark.read.parquet(decisions).drop("batch")
    expected, rejected = predict_batch(raw, card_score, strict=False, keep=keep)
    assert sorted(streamed.collect()) == sorted(expected.collect())
    assert spark.read.parquet(rejects).count() == rejected.count()
