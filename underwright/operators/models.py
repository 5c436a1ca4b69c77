"""Candidate classifiers as Spark ML estimators over a shared, leakage-safe feature matrix."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwright.functions.scalars import name, with_exprs
from underwright.operators import grown
from underwright.operators.knn import knn_vote
from underwright.operators.metrics import rank_metrics
from underwright.operators.splits import stratified_kfold
from underwright.operators.transforms import FeatureEngineer, Preprocess, class_weights, with_class_weight
from underwright.session import materialise
from underwright.sources.contract import ID, TARGET

SEED = 42
TUNED_C = 0.2157
PREFIX = "t_"
FIT_THREADS = 4

# --- estimators that Spark ML lacks ---------------------------------------------------------------


class FourierFeatures(Estimator, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of the Gaussian kernel with width 1 / (columns x variance)."""

    dimension = Param(Params._dummy(), "dimension", "output size", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "fourier", dimension: int = 256, seed: int = SEED):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="fourier", dimension=256, seed=SEED)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FourierFeaturesModel:
        x = dataset.select(vector_to_array(self.getInputCol()).alias("x"))
        row = x.selectExpr("max(size(x)) AS d", "avg(aggregate(x, 0D, (a, v) -> a + v) / size(x)) AS m",
                           "avg(aggregate(x, 0D, (a, v) -> a + v * v) / size(x)) AS s").first()
        variance = max(row["s"] - row["m"] ** 2, 1e-12)
        return FourierFeaturesModel(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(), dimension=self.getOrDefault(self.dimension),
            seed=self.getSeed(), width=row["d"], gamma=1.0 / (row["d"] * variance))


class FourierFeaturesModel(Model, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    dimension = Param(Params._dummy(), "dimension", "output size", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "input size", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "fourier", dimension: int = 256, seed: int = SEED,
                 width: int = 1, gamma: float = 1.0):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="fourier", dimension=256, seed=SEED, width=1, gamma=1.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, width = self.getOrDefault(self.dimension), self.getOrDefault(self.width)
        rng = np.random.RandomState(self.getSeed())
        weights = rng.normal(size=(width, size)) * np.sqrt(2 * self.getOrDefault(self.gamma))
        shift = rng.uniform(0, 2 * np.pi, size)

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype=object)
            return pd.Series(list(np.sqrt(2.0 / size) * np.cos(np.stack(x.to_numpy()) @ weights + shift)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))


class KnnVote:
    """Nearest-neighbour vote with the fit/transform shape of an estimator; the training rows are the model."""

    def __init__(self, k: int = 15) -> None:
        self.k = k
        self.train: DataFrame | None = None

    def fit(self, train: DataFrame) -> KnnVote:
        fitted = KnnVote(self.k)
        fitted.train = train
        return fitted

    @staticmethod
    def _flat(df: DataFrame, width: int) -> DataFrame:
        return df.withColumn("_x", vector_to_array("features")).selectExpr(
            "*", *[f"_x[{i}] AS _x{i}" for i in range(width)])

    def transform(self, df: DataFrame) -> DataFrame:
        first = self.train.select("features").first()
        width = len(first["features"])
        columns = [f"_x{i}" for i in range(width)]
        votes = knn_vote(self._flat(self.train, width), self._flat(df, width), columns, ID, "label", self.k)
        return df.join(votes, ID)


# --- registry -------------------------------------------------------------------------------------


def logistic(n_rows: int, c: float = 1.0, max_iter: int = 1000) -> LogisticRegression:
    """L2 logistic regression with inverse strength C; balanced weights sum to the row count."""
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter, tol=1e-4,
                              standardization=False, elasticNetParam=0.0, regParam=1.0 / (c * n_rows))


def forest(trees: int, depth: int, seed: int = SEED) -> RandomForestClassifier:
    """Random forest on the balanced weights. Each row's node in every tree is kept between levels: otherwise every level sends all trees to all tasks."""
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth,
                                  cacheNodeIds=True, seed=seed)


def boosted(rounds: int, depth: int, step: float = 0.1, weight: str | None = None, subsample: float = 1.0,
            columns: float = 1.0, min_rows: int = 1, seed: int = SEED) -> GBTClassifier:
    """Gradient-boosted trees; ``columns`` is the share of features tried per split."""
    subset = "all" if columns >= 1 else str(columns)
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step,
                          subsamplingRate=subsample, featureSubsetStrategy=subset, minInstancesPerNode=min_rows, seed=seed)
    return model.setWeightCol(weight) if weight else model


def kernel_svm(n_rows: int, c: float = 1.0, dimension: int = 256, max_iter: int = 100, seed: int = SEED) -> Pipeline:
    """Gaussian-kernel SVM on random Fourier features, with a logistic step that turns margins into probabilities."""
    return Pipeline(stages=[
        FourierFeatures(inputCol="features", outputCol="fourier", dimension=dimension, seed=seed),
        LinearSVC(featuresCol="fourier", labelCol="label", weightCol="weight", regParam=1.0 / (c * n_rows),
                  maxIter=max_iter, rawPredictionCol="svm_raw", predictionCol="svm_prediction"),
        VectorSlicer(inputCol="svm_raw", outputCol="margin", indices=[1]),
        LogisticRegression(featuresCol="margin", labelCol="label", maxIter=100),
    ])


def model_registry(n_rows: int, seed: int = SEED) -> dict[str, Callable]:
    """Name to estimator factory."""
    return {
        "Logistic Regression": lambda: logistic(n_rows),
        "Decision Tree": lambda: DecisionTreeClassifier(
            featuresCol="features", labelCol="label", weightCol="weight", maxDepth=8, seed=seed),
        "Random Forest": lambda: forest(200, 30, seed),
        "Gradient Boosting": lambda: boosted(200, 3, seed=seed),
        "XGBoost": lambda: boosted(300, 4, weight="pos_weight", subsample=0.9, columns=0.9, seed=seed),
        "LightGBM": lambda: boosted(300, 5, weight="pos_weight", subsample=0.9, columns=0.9, seed=seed),
        "CatBoost": lambda: boosted(300, 6, weight="weight", seed=seed),
        "SVM": lambda: kernel_svm(n_rows, seed=seed),
        "KNN": lambda: KnnVote(15),
        "Naive Bayes": lambda: NaiveBayes(featuresCol="features", labelCol="label", modelType="gaussian"),
    }


#: Shape of the border between the classes by the type of the last stage, and the types whose fit depends on the columns' scale.
BORDERS = {"LogisticRegression": "linear", "DecisionTreeClassifier": "steps", "RandomForestClassifier": "steps", "GBTClassifier": "steps", "Pipeline": "curved", "KnnVote": "local", "NaiveBayes": "quadratic"}
SCALED = ("LogisticRegression", "Pipeline", "KnnVote")
FACTS = "border string, needs_scaling boolean, class_weights boolean, trees int, fit_passes int, reason_codes boolean"


def model_facts(estimator) -> tuple:
    """What ``FACTS`` names, read from an estimator's own settings.

    ``trees`` are walked for each scored row; ``fit_passes`` is the most dependent passes over the training rows that a fit can
    take; reason codes need one weight per column.
    """

    def setting(stage, param: str) -> int | None:
        return stage.getOrDefault(param) if isinstance(stage, Params) and stage.hasParam(param) else None

    kind = type(estimator).__name__
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    depth, boosts = setting(estimator, "maxDepth"), kind == "GBTClassifier"
    trees = (setting(estimator, "numTrees") or (setting(estimator, "maxIter") if boosts else 1)) if depth else 0
    rounds = sum(setting(stage, "maxIter") or 0 for stage in stages)
    passes = depth * max(1, rounds) if depth else rounds or int(kind == "NaiveBayes")
    weighted = any(isinstance(stage, Params) and stage.hasParam("weightCol") and stage.isSet("weightCol") for stage in stages)
    return BORDERS[kind], kind in SCALED, weighted, trees, passes, kind == "LogisticRegression"


def model_reference_join(results: DataFrame, key: str = "model") -> DataFrame:
    """Result rows with the facts of their model; those of an unknown model are null."""
    facts = results.sparkSession.createDataFrame([(m, *model_facts(factory())) for m, factory in model_registry(1).items()], f"{key} string, {FACTS}")
    return results.join(F.broadcast(facts), key, "left")


# --- feature matrix -------------------------------------------------------------------------------


class Matrix:
    """Preprocessing fitted on training rows; turns cleaned rows into (id, label, features, weights)."""

    def __init__(self, train: DataFrame, selected: Sequence[str] | None = None, target: str = TARGET) -> None:
        self.target = target
        self.prep: PipelineModel = Pipeline(stages=[FeatureEngineer(), Preprocess(prefix=PREFIX)]).fit(train)
        available = self.prep.stages[-1].names()
        self.names = [n for n in (selected or available) if n in available]
        self.missing = [n for n in (selected or ()) if n not in available]
        self.weights = class_weights(train, target)

    def assembler(self) -> VectorAssembler:
        return VectorAssembler(inputCols=[PREFIX + n for n in self.names], outputCol="features")

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        labelled = with_exprs(df, {"label": f"CAST({self.target} AS DOUBLE)"})
        out = self.assembler().transform(self.prep.transform(labelled))
        return with_class_weight(out, "label", self.weights).select(ID, "label", "features", "weight", "pos_weight", *keep)

    def columns(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Selected transformed columns under their own names, as plain doubles."""
        return self.prep.transform(df).selectExpr(*keep, *[f"{name(PREFIX + n)} AS {name(n)}" for n in self.names])


def positive_scores(scored: DataFrame, keep: Sequence[str] = (ID, "label")) -> DataFrame:
    """Score set: P(good) where the model gives one, else its decision value, as (keep..., y, p)."""
    if "p" in scored.columns:
        p = F.col("p")
    else:
        column = "probability" if "probability" in scored.columns else "rawPrediction"
        p = F.element_at(vector_to_array(column), 2)
    return scored.select(*[c for c in keep if c != "label"], F.col("label").cast("int").alias("y"), p.alias("p"))


def auc_of(scores: DataFrame) -> float | None:
    return rank_metrics(scores).first()["roc_auc"]


# --- cross-validation -----------------------------------------------------------------------------


def fold_matrices(rows: DataFrame, k: int, seed: int = SEED, selected: Sequence[str] | None = None,
                  target: str = TARGET) -> list[DataFrame]:
    """One written matrix per fold, its preprocessing fitted without that fold; ``held`` marks the fold's rows."""
    folded = materialise(stratified_kfold(rows, k, seed, ID, target), "folds")

    def build(fold: int) -> DataFrame:
        matrix = Matrix(folded.filter(f"fold != {fold}"), selected, target)
        return materialise(matrix.transform(with_exprs(folded, {"held": f"fold = {fold}"}), ["held"]), f"fold-{fold}")

    with ThreadPoolExecutor(FIT_THREADS) as pool:
        return list(pool.map(build, range(k)))


def out_of_fold_scores(folds: Sequence[DataFrame], factory: Callable) -> DataFrame:
    """Scores of the held-out rows of every fold as (fold, id, y, p); all folds are fitted side by side."""

    def fit(part: DataFrame) -> DataFrame:
        model = grown.fit(factory(), part.filter("NOT held"))
        return positive_scores(model.transform(part.filter("held")))

    with ThreadPoolExecutor(max(1, len(folds))) as pool:
        parts = list(pool.map(fit, folds))
    out = None
    for i, part in enumerate(parts):
        tagged = part.selectExpr(f"{i} AS fold", "*")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def boosted_aucs(parts: Sequence[DataFrame], estimators: Sequence) -> list[list[float | None]]:
    """AUC of every boosted estimator on the held rows of every part, fitted on its others: all fits are one job, a task each."""
    settings = [grown.Boost.of(e) for e in estimators]
    needed = [(i, w) for i in range(len(parts)) for w in sorted({s.weight for s in settings}, key=str)]
    with ThreadPoolExecutor(FIT_THREADS) as pool:
        tables = list(pool.map(lambda t: grown.binned(parts[t[0]], t[1], "held"), needed))
    tasks = [(needed.index((i, s.weight)), s) for s in settings for i in range(len(parts))]
    scores = materialise(grown.boosted_scores(parts[0].sparkSession, tables, tasks), "scores")
    found = {r["task"]: r["roc_auc"] for r in rank_metrics(scores, ["task"]).collect()}  # a row per fit
    return [[found.get(k * len(parts) + i) for i in range(len(parts))] for k in range(len(settings))]


def mean_and_deviation(aucs: Sequence[float | None]) -> tuple[float | None, float | None]:
    known = [a for a in aucs if a is not None]
    return (float(np.mean(known)), float(np.std(known))) if known else (None, None)


def cross_validate_auc(folds: Sequence[DataFrame], factory: Callable) -> tuple[float, float]:
    """Mean and population deviation of the fold AUCs."""
    row = rank_metrics(out_of_fold_scores(folds, factory), ["fold"]).selectExpr(
        "avg(roc_auc) AS m", "stddev_pop(roc_auc) AS s").first()
    return row["m"], row["s"]


def compare_models(spark: SparkSession, train: DataFrame, validation: DataFrame, models: Mapping[str, Callable],
                   k: int = 5, seed: int = SEED, selected: Sequence[str] | None = None) -> DataFrame:
    """Cross-validated and validation AUC, time and status per model, best first; a failure is a row.

    The final fit of a model runs beside those of its folds.
    """
    folds = fold_matrices(train, k, seed, selected)
    matrix = Matrix(train, selected)
    fitted, held = materialise(matrix.transform(train), "train"), materialise(matrix.transform(validation), "validation")
    whole = fitted.selectExpr("*", "false AS held").unionByName(held.selectExpr("*", "true AS held"))
    n_rows, rows = None, []
    for model, factory in models.items():
        start = time.perf_counter()
        try:
            estimator = factory()
            if isinstance(estimator, GBTClassifier) and n_rows is None:
                n_rows = whole.count()
            if isinstance(estimator, GBTClassifier) and grown.by_tasks([estimator], n_rows):
                *aucs, auc = boosted_aucs([*folds, whole], [estimator])[0]
                rows.append((model, *mean_and_deviation(aucs), auc, time.perf_counter() - start, "ok"))
                continue
            with ThreadPoolExecutor(1) as beside:
                final = beside.submit(lambda: auc_of(positive_scores(grown.fit(factory(), fitted).transform(held))))
                mean, deviation = cross_validate_auc(folds, factory)
                auc = final.result()
            rows.append((model, mean, deviation, auc, time.perf_counter() - start, "ok"))
        except Exception as error:  # a failed model must not stop the comparison
            rows.append((model, None, None, None, time.perf_counter() - start, f"failed: {error}"))
    table = spark.createDataFrame(
        rows, "model string, cv_auc_mean double, cv_auc_std double, val_auc double, seconds double, status string")
    return table.selectExpr(
        "row_number() OVER (ORDER BY cv_auc_mean DESC NULLS LAST, model) AS rank", "model", "round(cv_auc_mean, 4) AS cv_auc_mean",
        "round(cv_auc_std, 4) AS cv_auc_std", "round(val_auc, 4) AS val_auc", "round(seconds, 2) AS seconds", "status")
