"""Search over model settings by cross-validated AUC, early stopping and the final fit."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwright.operators import grown
from underwright.operators.metrics import business_cost, evaluate_at_optimum, optimal_threshold, rank_metrics
from underwright.operators.models import (
    FIT_THREADS, SEED, TUNED_C, Matrix, boosted, boosted_aucs, cross_validate_auc, logistic, mean_and_deviation, positive_scores,
)
from underwright.session import dealt, materialise
from underwright.sources.contract import ID

# Candidate settings of the boosted challenger.
BOOSTED_SPACE = {
    "rounds": (200, 400, 600),
    "depth": (3, 4, 5, 6),
    "step": (0.01, 0.05, 0.1),
    "subsample": (0.8, 0.9, 1.0),
    "columns": (0.8, 0.9, 1.0),
    "min_rows": (1, 3, 5),
}
FIT_ROWS = 50_000  # rows of a task where many boosted fits run side by side
SMALL_ROWS = 10_000  # up to so many training rows early stopping keeps Spark's own fits, to the ties of equal splits
C_RANGE = (1e-3, 1e2)
C_FACTORS = (0.25, 0.5, 1.0, 2.0, 4.0)
PATIENCE = 30


@dataclass(frozen=True)
class Search:
    """Tried settings with their mean AUC, best first."""

    results: list[tuple[dict, float]]

    @property
    def best(self) -> dict:
        return self.results[0][0]


def draw_logistic(n: int, seed: int = SEED) -> list[dict]:
    """Log-uniform values of C."""
    rng = np.random.RandomState(seed)
    low, high = (math.log(c) for c in C_RANGE)
    return [{"c": float(math.exp(v))} for v in rng.uniform(low, high, n)]


def draw_boosted(n: int, seed: int = SEED) -> list[dict]:
    """Distinct random settings."""
    rng = np.random.RandomState(seed)
    out: list[dict] = []
    while len(out) < min(n, math.prod(map(len, BOOSTED_SPACE.values()))):
        pick = {k: v[rng.randint(len(v))] for k, v in BOOSTED_SPACE.items()}
        if pick not in out:
            out.append(pick)
    return out


def search(folds: Sequence[DataFrame], build: Callable[[dict], object], candidates: Sequence[dict]) -> Search:
    """Mean cross-validated AUC of every candidate; candidates run side by side, boosted trees with a task per fit."""
    estimators = [build(c) for c in candidates]
    if folds and estimators and grown.by_tasks(estimators, max(part.count() for part in folds)):
        aucs = [mean_and_deviation(found)[0] for found in boosted_aucs(folds, estimators)]
    else:
        with ThreadPoolExecutor(FIT_THREADS) as pool:
            aucs = list(pool.map(lambda c: cross_validate_auc(folds, lambda: build(c))[0], candidates))
    order = sorted(range(len(candidates)), key=lambda i: (-(aucs[i] or 0.0), i))
    return Search([(dict(candidates[i]), aucs[i]) for i in order])


def linear_scores(matrix: DataFrame, betas: np.ndarray) -> DataFrame:
    """Scores of every row by every logistic model (a row of ``betas``: coefficients, intercept), as (model, y, p)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, betas.shape[1] - 1)
            for k, beta in enumerate(betas):
                p = np.exp(-np.logaddexp(0, -(x @ beta[:-1] + beta[-1])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), batch.column("y"), pa.array(p)], ["model", "y", "p"])

    rows = matrix.select(F.col("label").cast("int").alias("y"), vector_to_array("features").alias("x"))
    return rows.mapInArrow(scored, "model int, y int, p double")


def search_logistic(folds: Sequence[DataFrame], n_rows: int, candidates: Sequence[dict]) -> Search:
    """``search`` over logistic regressions, with one scoring per fold and one ranking for all candidates; a fit has few tasks, and there are as many fits at once as cores."""
    folds = fewer_tasks(folds)

    def beta(task: tuple[int, dict]) -> list[float]:
        model = logistic(n_rows, task[1]["c"], 3000).fit(folds[task[0]].filter("NOT held"))
        return [*model.coefficients, model.intercept]

    tasks = [(i, c) for i in range(len(folds)) for c in candidates]
    with ThreadPoolExecutor(folds[0].sparkSession.sparkContext.defaultParallelism) as pool:
        betas = np.array(list(pool.map(beta, tasks))).reshape(len(folds), len(candidates), -1)
    scores = None
    for i, part in enumerate(folds):
        tagged = linear_scores(part.filter("held"), betas[i]).selectExpr(f"{i} AS fold", "*")
        scores = tagged if scores is None else scores.unionByName(tagged)
    ranked = rank_metrics(materialise(scores, "scores"), ["model", "fold"]).groupBy("model").agg(F.expr("avg(roc_auc) AS auc"))
    auc = {r["model"]: r["auc"] for r in ranked.collect()}  # a row per candidate
    order = sorted(range(len(candidates)), key=lambda i: (-(auc.get(i) or 0.0), i))
    return Search([(dict(candidates[i]), auc.get(i)) for i in order])


def random_search_logistic(folds: Sequence[DataFrame], n_rows: int, n_iter: int = 24, seed: int = SEED) -> Search:
    return search_logistic(folds, n_rows, draw_logistic(n_iter, seed))


def fewer_tasks(folds: Sequence[DataFrame]) -> list[DataFrame]:
    """The fold matrices with a task per ``FIT_ROWS`` rows: fits side by side fill the cores, and a small task costs more than its work."""
    return [dealt(part, -(-part.count() // FIT_ROWS) or 1, ID, f"fewer-{i}") for i, part in enumerate(folds)]


def random_search_boosted(folds: Sequence[DataFrame], n_iter: int = 30, seed: int = SEED) -> Search:
    folds = fewer_tasks(folds)
    return search(folds, lambda c: boosted(weight="pos_weight", seed=seed, **c), draw_boosted(n_iter, seed))


def grid_refine(folds: Sequence[DataFrame], n_rows: int, best_c: float) -> Search:
    """C times a quarter to four around the best random draw."""
    return search_logistic(folds, n_rows, [{"c": best_c * f} for f in C_FACTORS])


def search_table(spark: SparkSession, found: Search) -> DataFrame:
    rows = [(i + 1, str(settings), auc) for i, (settings, auc) in enumerate(found.results)]
    return spark.createDataFrame(rows, "rank int, settings string, cv_auc double")


def patience_stop(losses: Sequence[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """(best round counted from 0, whether ``patience`` rounds passed without a better loss)."""
    best, at = math.inf, -1
    for i, loss in enumerate(losses):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            return at, True
    return at, False


def early_stopping(train: DataFrame, validation: DataFrame, max_rounds: int = 2000, patience: int = PATIENCE,
                   first_rounds: int = 100, depth: int = 4, step: float = 0.05, seed: int = SEED) -> dict:
    """Boosting stopped after ``patience`` rounds without a lower validation loss.

    The model is grown in lengths, so a run that stops early never fits all rounds; the first trees are the same in every length.
    ``rounds_fitted`` counts in lengths that double, but every second one is left out, and the last ones are one fit of all rounds: the
    losses of a longer model tell where a shorter one would have stopped. Where the rows fit in a task, that task goes on round by round until it stops.
    """
    rounds = min(first_rounds, max_rounds)
    estimator = boosted(max_rounds, depth, step, "pos_weight", seed=seed)
    if isinstance(estimator, GBTClassifier):
        marked = train.selectExpr("*", "false AS held").unionByName(validation.selectExpr("*", "true AS held"))
        if train.count() > SMALL_ROWS and grown.by_tasks([estimator], marked.count()):
            losses, scores = grown.boosted_until(marked, "held", estimator, patience)
            while rounds < max_rounds and not patience_stop(losses[:rounds], patience)[1]:
                rounds = min(max_rounds, rounds * 2)
            return {"best_iteration": patience_stop(losses, patience)[0], "val_auc": evaluate_at_optimum(scores).first()["roc_auc"],
                    "rounds_fitted": rounds, "max_iterations": max_rounds}
    while True:
        model = boosted(rounds, depth, step, "pos_weight", seed=seed).fit(train)
        losses = model.evaluateEachIteration(validation)
        best, stopped = patience_stop(losses, patience)
        if stopped or rounds >= max_rounds:
            break
        rounds = rounds * 4 if rounds * 8 <= max_rounds else max_rounds
    doubled = min(first_rounds, max_rounds)
    while doubled < rounds and not patience_stop(losses[:doubled], patience)[1]:
        doubled = min(rounds, doubled * 2)
    final = boosted(best + 1, depth, step, "pos_weight", seed=seed).fit(train) if best + 1 < rounds else model
    metrics = evaluate_at_optimum(positive_scores(final.transform(validation))).first()
    return {"best_iteration": best, "val_auc": metrics["roc_auc"], "rounds_fitted": doubled, "max_iterations": max_rounds}


def evaluate_estimator(model, data: DataFrame, cost_fp: float = 5.0, cost_fn: float = 1.0) -> dict:
    """Metrics of a fitted model at its cheapest threshold."""
    return evaluate_at_optimum(positive_scores(model.transform(data)), cost_fp, cost_fn).first().asDict()


def before_after(spark: SparkSession, train: DataFrame, validation: DataFrame, pairs: Mapping[str, tuple]) -> DataFrame:
    """Validation metrics of each model with default and with tuned settings."""
    rows = []
    for model, estimators in pairs.items():
        for stage, estimator in zip(("default", "tuned"), estimators):
            m = evaluate_estimator(estimator.fit(train), validation)
            rows.append((model, stage, m["roc_auc"], m["ks"], m["brier"], m["opt_threshold"], m["cost_per_applicant"]))
    return spark.createDataFrame(rows, "model string, stage string, roc_auc double, ks double, brier double, "
                                       "opt_threshold double, cost_per_applicant double")


def final_pair(best: Mapping[str, dict], train: DataFrame, n_rows: int, seed: int = SEED) -> dict:
    """Tuned logistic regression and tuned boosted challenger refitted on the training matrix."""
    c = best.get("Logistic Regression", {}).get("c", TUNED_C)
    boost: dict = {"rounds": 300, "depth": 4, **best.get("XGBoost", {})}
    challenger: GBTClassifier = boosted(weight="pos_weight", seed=seed, **boost)
    return {"Logistic Regression": logistic(n_rows, c).fit(train), "XGBoost": challenger.fit(train)}


def final_fit(train: DataFrame, validation: DataFrame, test: DataFrame, c: float = TUNED_C,
              selected: Sequence[str] | None = None) -> dict:
    """Tuned logistic regression on the training rows; the threshold comes from validation alone."""
    matrix = Matrix(train, selected)
    fitted = materialise(matrix.transform(train), "fitted")
    model = logistic(fitted.count(), c).fit(fitted)
    held = materialise(positive_scores(model.transform(matrix.transform(validation))), "held")
    tested = materialise(positive_scores(model.transform(matrix.transform(test))), "tested")
    threshold = optimal_threshold(held).first()["threshold"]
    return {
        "matrix": matrix, "model": model, "threshold": threshold,
        "validation": evaluate_at_optimum(held).first().asDict(),
        "test": evaluate_at_optimum(tested).first().asDict(),
        "test_cost_at_validation_threshold":
            business_cost(tested, threshold).first()["cost_per_applicant"],
    }
