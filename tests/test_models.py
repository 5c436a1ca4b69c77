"""Classifiers, search, selection and explanations on the small applicant table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array

from underwright.operators import eda, explain, models, selection, tuning
from underwright.operators.cleaning import clean_applicants
from underwright.operators.knn import knn_neighbours
from underwright.operators.splits import stratified_split
from underwright.plans.batch_scoring import model_score, predict_batch
from underwright.session import materialise, scratch_path
from underwright.sources import files
from underwright.sources.applicants import applicants


@pytest.fixture(scope="module")
def rows(spark):
    return materialise(stratified_split(materialise(clean_applicants(applicants(spark, "/root/testdata/sf0.01")), "c")), "s")


@pytest.fixture(scope="module")
def fitted(rows):
    matrix = models.Matrix(rows.filter("split = 'train'"))
    table = materialise(matrix.transform(rows, ["split"]), "m")
    return matrix, table.filter("split = 'train'"), table.filter("split = 'validation'")


@pytest.mark.parametrize("name", list(models.model_registry(1)))
def test_every_model_beats_chance(fitted, name):
    _, train, validation = fitted
    estimator = models.model_registry(train.count())[name]()
    if name not in ("Decision Tree", "Logistic Regression", "SVM", "KNN", "Naive Bayes"):  # the shape of a fit needs few trees
        estimator = estimator.setNumTrees(6) if name == "Random Forest" else estimator.setMaxIter(9)
    scores = models.positive_scores(estimator.fit(train).transform(validation))
    assert scores.count() == validation.count() and models.auc_of(scores) > 0.6


def test_a_failing_model_is_a_row(spark, rows):
    def broken():
        raise RuntimeError("no")

    train, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    registry = models.model_registry(train.count())
    table = models.compare_models(spark, train, validation, {"Broken": broken, "Naive Bayes": registry["Naive Bayes"]}, k=2).collect()
    assert [(r["rank"], r["model"], r["status"]) for r in table] == [
        (1, "Naive Bayes", "ok"), (2, "Broken", "failed: no")]
    facts = {r["model"]: tuple(r)[1:] for r in models.model_reference_join(spark.createDataFrame([("X",), ("XGBoost",), ("Random Forest",), ("SVM",), ("KNN",)], "model string")).collect()}
    assert facts["X"] == (None,) * 6 and facts["XGBoost"] == ("steps", False, True, 300, 1200, False) and facts["Random Forest"] == ("steps", False, True, 200, 30, False)
    assert facts["SVM"][:2] == ("curved", True) and facts["SVM"][4] > 100 and facts["KNN"] == ("local", True, False, 0, 0, False)


def test_patience():
    assert tuning.patience_stop([5, 4, 3, 3, 3, 3], 3) == (2, True)
    assert tuning.patience_stop([5, 4, 3, 3], 3) == (2, False)


def test_search_draws_are_reproducible_and_in_range():
    assert tuning.draw_logistic(5) == tuning.draw_logistic(5)
    assert all(1e-3 <= d["c"] <= 1e2 for d in tuning.draw_logistic(50))
    drawn = tuning.draw_boosted(30)
    assert len({str(d) for d in drawn}) == 30


def test_saved_model_scores_the_same(spark, rows, fitted):
    matrix, train, _ = fitted
    model = PipelineModel(stages=[*matrix.prep.stages, matrix.assembler(), models.logistic(train.count()).fit(train)])
    path = scratch_path(spark, "model")
    files.save_model(model, path)
    loaded, metadata = files.load_model(spark, path)
    held = rows.filter("split = 'test'").selectExpr("*", "CAST(creditworthy AS DOUBLE) AS label")
    parity = files.reload_parity(models.positive_scores(model.transform(held)), models.positive_scores(loaded.transform(held)))
    assert parity.first()["equal"] and metadata == {}
    decided, rejected = predict_batch(held, model_score(loaded), 0.6, strict=False)
    assert decided.count() + rejected.count() == held.count()
    assert decided.filter("(p_creditworthy > 0.6001) != (decision = 'Approve') AND abs(p_creditworthy - 0.6) > 0.001").count() == 0


@pytest.mark.parametrize("blocks", [(2000, 20000), (2000, 20000, 0), (37, 53, 0)])
def test_neighbours_equal_brute_force_for_any_block_size(spark, blocks):
    rng = np.random.RandomState(0)
    t, q = rng.randn(400, 3), rng.randn(60, 3)
    t[:130] = t[0]  # a third of the rows are copies of one
    names = ["a", "b", "c"]
    train = spark.createDataFrame([(f"t{i:04d}", *map(float, v), i % 2) for i, v in enumerate(t)], "id string, a double, b double, c double, y int")
    query = spark.createDataFrame([(f"q{i:04d}", *map(float, v)) for i, v in enumerate(q)], "id string, a double, b double, c double")
    found = knn_neighbours(train, query, names, "id", "y", 15, *blocks).collect()
    assert len(found) == 60 * 15
    got: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["neighbour"])
    for i, v in enumerate(q):
        d = ((t - v) ** 2).sum(axis=1)
        assert got[f"q{i:04d}"] == [f"t{j:04d}" for j in sorted(range(400), key=lambda j: (d[j], j))[:15]]


def test_shapley_values_add_up(spark, fitted):
    matrix, train, validation = fitted
    model = models.logistic(train.count()).fit(train)
    score = explain.model_margin(model, matrix.names)
    sample = validation.select("customer_id", vector_to_array("features").alias("x")).limit(5)
    sample = materialise(sample, "sample")
    background = materialise(train.select("customer_id", vector_to_array("features").alias("x")).limit(1), "background")
    values = explain.shap_values(sample, background, matrix.names, score, 2)
    sums = {r[0]: r[1] for r in values.groupBy("customer_id").sum("contribution").collect()}
    base = score(background).first()["margin"]
    for r in score(sample).collect():
        assert sums[r["customer_id"]] == pytest.approx(r["margin"] - base, abs=1e-8)


def test_correlation_equals_numpy(spark, clean):
    columns = ["credit_score", "interest_rate", "monthly_income"]
    pdf = clean.select(*columns).toPandas()
    expected = pdf.corr()
    for r in eda.pearson_pairs(clean, columns).collect():
        assert r["r"] == pytest.approx(expected.loc[r["a"], r["b"]], abs=1e-12)


def test_vif_of_dependent_and_constant_columns(spark):
    rng = np.random.RandomState(1)
    a, b = rng.randn(300), rng.randn(300)
    df = spark.createDataFrame([(float(x), float(y), float(x + y), 1.0, float(z)) for x, y, z in zip(a, b, rng.randn(300))],
                               "a double, b double, s double, k double, z double")
    found = {r["feature"]: r["vif"] for r in selection.vif(df, ["a", "b", "s", "k", "z"]).collect()}
    assert found["a"] == found["b"] == found["s"] == float("inf") and found["k"] == 1.0 and 1.0 <= found["z"] < 1.2


def test_selection_keeps_informative_features(spark, clean):
    df = clean.selectExpr("customer_id", "creditworthy", "CAST(creditworthy AS DOUBLE) + age / 1000 AS strong", "age AS weak",
                          "1D AS flat", "interest_rate AS rate").na.drop()
    found = selection.run_selection(df, ["strong", "weak", "flat", "rate"], top_k=2, trees=10, repeats=1)
    final = [r["feature"] for r in found["final"].collect()]
    assert "strong" in final and "flat" not in final
