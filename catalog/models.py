"""Queries that fit classifiers on the training rows and score the validation rows.

Fits have no SQL counterpart except Gaussian naive Bayes and the nearest-neighbour vote. Single fits run with
the full settings of the library.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from catalog.fitted import OUTPUT_NAMES, PREPROCESSED, split_rows
from catalog.registry import cleaned, raw, register, round_doubles
from catalog.sql import r, sql
from catalog.tables import SPLIT_SQL
from underwright.functions.scalars import rounded
from underwright.operators import grown, metrics, models, tuning
from underwright.operators.knn import knn_neighbours, knn_vote
from underwright.operators.splits import stratified_split
from underwright.plans.tuning import tuning_run
from underwright.session import dealt, materialise, scratch_path
from underwright.sources.contract import ID
from underwright.sources.scorecard import TERM_INPUTS, scored


EVEN_ROWS = 100_000  # a matrix of more rows is dealt evenly over all cores


def split_cleaned(spark, sf):
    return materialise(stratified_split(materialise(cleaned(spark, sf), "cleaned")), "split")


def matrices(spark, sf, selected=None):
    """(matrix, train, validation) with the preprocessing fitted on the training rows."""
    rows = split_cleaned(spark, sf)
    matrix = models.Matrix(rows.filter("split = 'train'"), selected)
    known = rows.filter("split != 'test'")
    table = matrix.transform(known, ["split"])
    # adaptive execution goes by the bytes of the split table, which leaves a few uneven files; a fit has a pass per level of each tree
    table = dealt(table, spark.sparkContext.defaultParallelism, ID, "matrix") if known.count() > EVEN_ROWS else materialise(table, "matrix")
    return matrix, table.filter("split = 'train'"), table.filter("split = 'validation'")


def _fit(query, model):
    def run(spark, sf):
        _, train, validation = matrices(spark, sf)
        estimator = models.model_registry(train.count())[model]()
        return round_doubles(models.positive_scores(grown.fit(estimator, train).transform(validation)))

    register(query)(run)


for _query, _model in (("fit_logreg", "Logistic Regression"), ("fit_tree", "Decision Tree"), ("fit_forest", "Random Forest"),
                       ("fit_gbt", "Gradient Boosting"), ("fit_gbt_xgb", "XGBoost"), ("fit_gbt_lgbm", "LightGBM"),
                       ("fit_gbt_cat", "CatBoost"), ("fit_svm", "SVM")):
    _fit(_query, _model)

# --- models with a SQL counterpart ----------------------------------------------------------------

_TERMS = list(TERM_INPUTS)
_TERM_SQL = ("SELECT customer_id, creditworthy, split, coalesce(credit_score, 600e0) / 100e0 AS score, "
             "coalesce(credit_utilization_ratio, 0.5e0) AS util, coalesce(payment_consistency, 0.9e0) AS pc, "
             "least(coalesce(dti_ratio, 0.2e0), 2e0) AS dti FROM features JOIN split USING (customer_id, creditworthy)")
_TERM_CTES = {"split": SPLIT_SQL.format(val=0.2), "x": _TERM_SQL, "tr": "SELECT * FROM x WHERE split = 'train'",
              "va": "SELECT * FROM x WHERE split = 'validation'"}


def term_rows(spark, sf):
    """Four numeric inputs without missing values, split."""
    return split_rows(spark, sf).selectExpr(
        "customer_id", "creditworthy", "split", "coalesce(credit_score, 600D) / 100D AS score",
        "coalesce(credit_utilization_ratio, 0.5D) AS util", "coalesce(payment_consistency, 0.9D) AS pc",
        "least(coalesce(dti_ratio, 0.2D), 2D) AS dti")


_DIST = " + ".join(f"pow(va.{t} - tr.{t}, 2)" for t in _TERMS)
_NEAR_SQL = sql(
    f"SELECT customer_id, neighbour, CAST(rank AS INTEGER) AS rank, {r('distance2')} AS distance2 FROM (SELECT va.customer_id, "
    f"tr.customer_id AS neighbour, {_DIST} AS distance2, row_number() OVER (PARTITION BY va.customer_id ORDER BY {_DIST}, tr.customer_id) "
    "AS rank FROM va, tr) WHERE rank <= 15", "features", **_TERM_CTES)
register("knn_join", _NEAR_SQL)(lambda spark, sf: _neighbours(spark, sf))
#: The same rows through the metric index that larger training tables take.
register("knn_join_indexed", _NEAR_SQL)(lambda spark, sf: _neighbours(spark, sf, broadcast_cells=0))


def _neighbours(spark, sf, **settings):
    rows = term_rows(spark, sf)
    near = knn_neighbours(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), _TERMS, "customer_id", "creditworthy", **settings)
    return near.selectExpr("customer_id", "neighbour", "rank", f"{rounded('distance2')} AS distance2")


@register("knn_vote", sql(
    f"SELECT customer_id, {r('avg(y)')} AS p FROM (SELECT va.customer_id, tr.creditworthy AS y, row_number() OVER (PARTITION BY "
    f"va.customer_id ORDER BY {_DIST}, tr.customer_id) AS rank FROM va, tr) WHERE rank <= 15 GROUP BY 1", "features", **_TERM_CTES))
def _knn_vote(spark, sf):
    rows = term_rows(spark, sf)
    return round_doubles(knn_vote(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), _TERMS, "customer_id", "creditworthy"))


_LOGP = " + ".join(f"(-0.5e0 * ln(2 * pi() * v_{t}) - pow({t} - m_{t}, 2) / (2 * v_{t}))" for t in _TERMS)
_EPS = "1e-9 * (SELECT greatest(" + ", ".join(f"var_pop({t})" for t in _TERMS) + ") FROM tr)"


@register("fit_gnb", sql(
    f"SELECT customer_id, y, round(max(CASE WHEN class = 1 THEN e END) / sum(e), 4) + 0e0 AS p FROM (SELECT customer_id, y, class, "
    "exp(lp - max(lp) OVER (PARTITION BY customer_id)) AS e FROM (SELECT va.customer_id, va.creditworthy AS y, c.class, ln(prior) + "
    f"{_LOGP} AS lp FROM va CROSS JOIN c)) GROUP BY 1, 2", "features", **_TERM_CTES,
    c="SELECT creditworthy AS class, count(*) * 1e0 / (SELECT count(*) FROM tr) AS prior, " + ", ".join(
        f"avg({t}) AS m_{t}, var_pop({t}) + {_EPS} AS v_{t}" for t in _TERMS) + " FROM tr GROUP BY 1"))
def _fit_gnb(spark, sf):
    rows = VectorAssembler(inputCols=_TERMS, outputCol="features").transform(
        term_rows(spark, sf).selectExpr("*", "CAST(creditworthy AS DOUBLE) AS label"))
    model = models.model_registry(1)["Naive Bayes"]().fit(rows.filter("split = 'train'"))
    return round_doubles(models.positive_scores(model.transform(rows.filter("split = 'validation'"))), 4)


# --- the same two models over the whole matrix ----------------------------------------------------

_WHOLE_CTES = {
    **PREPROCESSED,
    "x": f"SELECT customer_id, m.split, f.creditworthy, {', '.join(OUTPUT_NAMES)} FROM (SELECT customer_id, split, {', '.join(OUTPUT_NAMES)} FROM matrix) m "
         "JOIN (SELECT customer_id, creditworthy FROM features) f USING (customer_id)",
    "tr": "SELECT * FROM x WHERE split = 'train'", "va": "SELECT * FROM x WHERE split = 'validation'"}


def _scored_whole(spark, sf, model, digits):
    _, train, validation = matrices(spark, sf)
    estimator = models.model_registry(train.count())[model]()
    return round_doubles(models.positive_scores(estimator.fit(train).transform(validation)), digits)


_WHOLE_DIST = " + ".join(f"pow(va.{c} - tr.{c}, 2)" for c in OUTPUT_NAMES)


@register("knn_vote_matrix", sql(
    f"SELECT customer_id, y, {r('avg(vote)')} AS p FROM (SELECT customer_id, y, vote, row_number() OVER (PARTITION BY customer_id ORDER BY d, near) AS rank FROM "
    f"(SELECT va.customer_id, CAST(va.creditworthy AS INTEGER) AS y, tr.customer_id AS near, tr.creditworthy AS vote, {_WHOLE_DIST} AS d FROM va, tr)) "
    "WHERE rank <= 15 GROUP BY 1, 2", "features", **_WHOLE_CTES))
def _knn_vote_matrix(spark, sf):
    return _scored_whole(spark, sf, "KNN", 6)


_WHOLE_LOGP = " + ".join(f"(-0.5e0 * ln(2 * pi() * v{k}) - pow({c} - m{k}, 2) / (2 * v{k}))" for k, c in enumerate(OUTPUT_NAMES))
_WHOLE_EPS = "1e-9 * (SELECT greatest(" + ", ".join(f"var_pop({c})" for c in OUTPUT_NAMES) + ") FROM tr)"


@register("fit_gnb_matrix", sql(
    "SELECT customer_id, y, round(max(CASE WHEN class = 1 THEN e END) / sum(e), 4) + 0e0 AS p FROM (SELECT customer_id, y, class, exp(lp - max(lp) OVER "
    "(PARTITION BY customer_id)) AS e FROM (SELECT customer_id, CAST(creditworthy AS INTEGER) AS y, class, ln(prior) + "
    f"{_WHOLE_LOGP} AS lp FROM va CROSS JOIN c)) GROUP BY 1, 2", "features", **_WHOLE_CTES,
    c="SELECT creditworthy AS class, count(*) * 1e0 / (SELECT count(*) FROM tr) AS prior, " + ", ".join(
        f"avg({c}) AS m{k}, var_pop({c}) + {_WHOLE_EPS} AS v{k}" for k, c in enumerate(OUTPUT_NAMES)) + " FROM tr GROUP BY 1"))
def _fit_gnb_matrix(spark, sf):
    return _scored_whole(spark, sf, "Naive Bayes", 4)


# --- comparison and tuning ------------------------------------------------------------------------


_ESTIMATORS = {
    "Logistic Regression": "LogisticRegression", "Decision Tree": "DecisionTreeClassifier", "Random Forest": "RandomForestClassifier",
    "Gradient Boosting": "GBTClassifier", "XGBoost": "GBTClassifier", "LightGBM": "GBTClassifier", "CatBoost": "GBTClassifier",
    "SVM": "Pipeline", "KNN": "KnnVote", "Naive Bayes": "NaiveBayes",
}


@register("model_registry", sql(
    f"SELECT model, estimator, train_rows, pos_weight FROM (VALUES {', '.join(f'({m!r}, {e!r})' for m, e in _ESTIMATORS.items())}) AS e(model, estimator), "
    f"(SELECT CAST(count(*) AS BIGINT) AS train_rows, {r('sum(1 - creditworthy) * 1e0 / sum(creditworthy)')} AS pos_weight FROM s WHERE split = 'train')",
    "cleaned", s=SPLIT_SQL.format(val=0.2)))
def _model_registry(spark, sf):
    """Every registered estimator with the size and class weight of the training rows it would get."""
    train = split_cleaned(spark, sf).filter("split = 'train'")
    n = train.count()
    weights = models.class_weights(train, "creditworthy")
    rows = [(m, type(f()).__name__, n, weights["pos"]) for m, f in models.model_registry(n).items()]
    return round_doubles(spark.createDataFrame(rows, "model string, estimator string, train_rows bigint, pos_weight double"))


@register("model_reference_join", sql(
    "SELECT t.model, roc_auc, border, needs_scaling, class_weights, trees, fit_passes, reason_codes FROM (SELECT CASE model WHEN 'scorecard' THEN 'Logistic Regression' WHEN 'squared' THEN "
    "'Naive Bayes' ELSE model END AS model, auc AS roc_auc FROM (SELECT model, round(sum(n1 * (c0 - n0 / 2)) / max(t1 * t0), 6) AS auc "
    "FROM (SELECT model, n1, n0, sum(n0) OVER (PARTITION BY model ORDER BY p) AS c0, sum(n1) OVER (PARTITION BY model) AS t1, sum(n0) OVER "
    "(PARTITION BY model) AS t0 FROM (SELECT model, p, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM model_scores "
    "GROUP BY ALL)) GROUP BY 1)) t LEFT JOIN (VALUES ('Logistic Regression', 'linear', true, true, CAST(0 AS INTEGER), CAST(1000 AS INTEGER), true), "
    "('Naive Bayes', 'quadratic', false, false, 0, 1, false)) f(model, border, needs_scaling, class_weights, trees, fit_passes, reason_codes) ON f.model = t.model", "model_scores"))
def _model_reference_join(spark, sf):
    from underwright.sources.scorecard import score_variants

    table = metrics.rank_metrics(score_variants(scored(raw(spark, sf))), ["model"]).selectExpr(
        "CASE model WHEN 'scorecard' THEN 'Logistic Regression' WHEN 'squared' THEN 'Naive Bayes' ELSE model END AS model", "roc_auc")
    return models.model_reference_join(table)


@register("positive_scores")
def _positive_scores(spark, sf):
    _, train, validation = matrices(spark, sf)
    svc = models.LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", maxIter=50).fit(train)
    return round_doubles(models.positive_scores(svc.transform(validation)))


@register("cross_validate_auc")
def _cross_validate_auc(spark, sf):
    rows = split_cleaned(spark, sf).filter("split = 'train'")
    folds = models.fold_matrices(rows, 5)
    n = rows.count()
    scores = models.out_of_fold_scores(folds, lambda: models.logistic(n))
    return metrics.rank_metrics(scores, ["fold"]).select("fold", "roc_auc", "ks")


@register("compare_models")
def _compare_models(spark, sf):
    rows = split_cleaned(spark, sf)
    train = rows.filter("split = 'train'")
    registry = models.model_registry(train.count())
    return models.compare_models(spark, train, rows.filter("split = 'validation'"), registry)


@register("random_search")
def _random_search(spark, sf):
    rows = split_cleaned(spark, sf).filter("split = 'train'")
    folds = models.fold_matrices(rows, 5)
    return tuning.search_table(spark, tuning.random_search_logistic(folds, rows.count()))


@register("random_search_boosted")
def _random_search_boosted(spark, sf):
    folds = models.fold_matrices(split_cleaned(spark, sf).filter("split = 'train'"), 5)
    return tuning.search_table(spark, tuning.random_search_boosted(folds))


@register("grid_refine")
def _grid_refine(spark, sf):
    rows = split_cleaned(spark, sf).filter("split = 'train'")
    folds = models.fold_matrices(rows, 5)
    n = rows.count()
    return tuning.search_table(spark, tuning.grid_refine(folds, n, tuning.random_search_logistic(folds, n).best["c"]))


@register("tuning_run")
def _tuning_run(spark, sf):
    """The logistic half with its 24 draws, grid and final fit, run twice over one journal; the table and fits are those of the second run."""
    train, path = split_cleaned(spark, sf).filter("split = 'train'"), scratch_path(spark, "journal")
    tuning_run(train, path, n_boosted=0)
    again = tuning_run(train, path, n_boosted=0)
    return round_doubles(again["searches"].withColumn("fitted_again", F.lit(again["fitted"])))


@register("early_stopping")
def _early_stopping(spark, sf):
    _, train, validation = matrices(spark, sf)
    found = tuning.early_stopping(train, validation)
    return spark.createDataFrame([tuple(found.values())], "best_iteration int, val_auc double, rounds_fitted int, max_iterations int")


@register("before_after")
def _before_after(spark, sf):
    """The default boosted model has the defaults of the reference's library; the tuned settings are those that the searches find."""
    _, train, validation = matrices(spark, sf)
    rows = split_cleaned(spark, sf).filter("split = 'train'")
    folds = models.fold_matrices(rows, 5)
    n = rows.count()
    refined = tuning.grid_refine(folds, n, tuning.random_search_logistic(folds, n).best["c"])
    return tuning.before_after(spark, train, validation, {
        "Logistic Regression": (models.logistic(n), models.logistic(n, refined.best["c"], 3000)),
        "XGBoost": (models.boosted(100, 6, 0.3, "pos_weight"), models.boosted(weight="pos_weight", **tuning.random_search_boosted(folds).best)),
    })


@register("fit_final_pair")
def _fit_final_pair(spark, sf):
    _, train, validation = matrices(spark, sf)
    best = {"Logistic Regression": {"c": models.TUNED_C}, "XGBoost": {}}
    out = None
    for model, fitted in tuning.final_pair(best, train, train.count()).items():
        part = models.positive_scores(fitted.transform(validation)).selectExpr(f"'{model}' AS model", "*")
        out = part if out is None else out.unionByName(part)
    return round_doubles(out)


@register("final_fit")
def _final_fit(spark, sf):
    rows = split_cleaned(spark, sf)
    train, validation, test = (rows.filter(f"split = '{s}'") for s in ("train", "validation", "test"))
    found = tuning.final_fit(train, validation, test)
    entries = [(part, found["threshold"], found[part]["roc_auc"], found[part]["ks"], found[part]["brier"], found[part]["opt_threshold"],
                found[part]["cost_per_applicant"]) for part in ("validation", "test")]
    return spark.createDataFrame(
        entries, "part string, threshold double, roc_auc double, ks double, brier double, opt_threshold double, cost double").withColumn(
        "test_cost_at_threshold", F.lit(found["test_cost_at_validation_threshold"]))
