"""Queries on score sets: confusion, ranking metrics, thresholds, curves and model comparison."""

from __future__ import annotations

from catalog.registry import model_scores, register, scores
from catalog.sql import r, sql
from underwright.operators import metrics

_CONF = ("SELECT count(CASE WHEN p >= {t} AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p < {t} AND y = 0 THEN 1 END) AS tn, "
         "count(CASE WHEN p >= {t} AND y = 0 THEN 1 END) AS fp, count(CASE WHEN p < {t} AND y = 1 THEN 1 END) AS fn FROM scored")
CONF = _CONF.replace("{t}", "0.5e0")


def _q(a: str, b: str) -> str:
    return f"round(coalesce(({a}) * 1e0 / nullif({b}, 0), 0), 4)"


_RATIOS = (f"{_q('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_q('tp', 'tp + fp')} AS precision, {_q('tp', 'tp + fn')} AS recall, "
           f"{_q('2 * tp', '2 * tp + fp + fn')} AS f1, {_q('tn', 'tn + fp')} AS specificity")
_RATES = f"{_q('tp + fp', 'tp + tn + fp + fn')} AS approval_rate, {_q('fp', 'tp + fp')} AS bad_rate"
_COSTS = f"CAST(5 * fp + fn AS DOUBLE) AS total_cost, {_q('5 * fp + fn', 'tp + tn + fp + fn')} AS cost_per_applicant"
_FOUR = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("tp", "tn", "fp", "fn"))

register("confusion", sql(f"SELECT {_FOUR} FROM c", "scored", c=CONF))(
    lambda spark, sf: metrics.confusion(scores(spark, sf)))
register("confusion_matrix_table", sql(
    "SELECT CAST(a AS INTEGER) AS actual, CAST(b AS INTEGER) AS predicted, CAST(n AS BIGINT) AS n FROM (SELECT 0 AS a, 0 AS b, tn AS n FROM c "
    "UNION ALL SELECT 0, 1, fp FROM c UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c)", "scored", c=CONF))(
    lambda spark, sf: metrics.confusion_matrix_table(scores(spark, sf)))
register("accuracy_precision_recall_f1_specificity", sql(f"SELECT {_RATIOS} FROM c", "scored", c=CONF))(
    lambda spark, sf: metrics.accuracy_precision_recall_f1_specificity(scores(spark, sf)))
register("approval_and_bad_rate", sql(f"SELECT {_RATES} FROM c", "scored", c=CONF))(
    lambda spark, sf: metrics.approval_and_bad_rate(scores(spark, sf)))
register("business_cost", sql(
    f"SELECT CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {_COSTS} FROM c", "scored", c=CONF))(
    lambda spark, sf: metrics.business_cost(scores(spark, sf)))


def ranked(source: str, by: str = "") -> dict[str, str]:
    """CTEs w (running class counts per distinct score) and rk (ranking metrics) of a score table."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return {
        "g": f"SELECT {key}p, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM {source} GROUP BY ALL",
        "w": f"SELECT *, sum(n1) OVER ({part}ORDER BY p) AS c1, sum(n0) OVER ({part}ORDER BY p) AS c0, "
             f"sum(n1) OVER ({part}ORDER BY p DESC) AS a1, sum(n0) OVER ({part}ORDER BY p DESC) AS a0, "
             f"sum(n1) OVER ({part}) AS t1, sum(n0) OVER ({part}) AS t0 FROM g",
        "rk": f"SELECT {key}round(sum(n1 * (c0 - n0 / 2)) / max(t1 * t0), 6) AS roc_auc, "
              "round(sum(n1 / t1 * a1 / (a1 + a0)), 6) AS pr_auc, round(max(abs(c1 / t1 - c0 / t0)), 6) AS ks, "
              f"round(sum(n1 * (1 - p) * (1 - p) + n0 * p * p) / max(t1 + t0), 6) AS brier FROM w {group}",
    }


for _name in ("roc_auc", "pr_auc", "ks"):
    register(_name, sql(f"SELECT {_name} FROM rk", "scored", **ranked("scored")))(
        lambda spark, sf, metric=getattr(metrics, _name): metric(scores(spark, sf)))
register("brier", sql("SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM scored", "scored"))(
    lambda spark, sf: metrics.brier(scores(spark, sf)))
register("pr_auc_trapezoid", sql(
    "SELECT round(sum(n1 / t1 * (a1 / (a1 + a0) + coalesce(before, 1e0)) / 2), 6) AS pr_auc_trapezoid FROM (SELECT *, "
    "lag(a1 / (a1 + a0)) OVER (ORDER BY p DESC) AS before FROM w)", "scored", **ranked("scored")))(
    lambda spark, sf: metrics.pr_auc_trapezoid(scores(spark, sf)))
register("roc_points", sql(
    "SELECT p AS threshold, round(a0 / t0, 6) AS fpr, round(a1 / t1, 6) AS tpr, round(a0 / t0, 6) AS random_tpr FROM w", "scored",
    **ranked("scored")))(lambda spark, sf: metrics.roc_points(scores(spark, sf)))
register("pr_points", sql(
    "SELECT p AS threshold, round(a1 / (a1 + a0), 6) AS precision, round(a1 / t1, 6) AS recall, round(t1 / (t1 + t0), 6) AS base_rate "
    "FROM w", "scored", **ranked("scored")))(lambda spark, sf: metrics.pr_points(scores(spark, sf)))
register("metric_suite", sql(
    f"SELECT 0.5e0 AS threshold, {_FOUR}, {_RATIOS}, {_RATES}, roc_auc, pr_auc, ks, brier FROM c CROSS JOIN rk", "scored", c=CONF,
    **ranked("scored")))(lambda spark, sf: metrics.metric_suite(scores(spark, sf)))


def swept(source: str, by: str = "") -> dict[str, str]:
    """CTE sw: confusion counts and cost of every threshold, by brute force."""
    key = f"{by}, " if by else ""
    return {
        "grid": "SELECT k / 1e2 AS threshold FROM (SELECT unnest(range(1, 100)) AS k)",
        "cf": f"SELECT {key}threshold, count(CASE WHEN p >= threshold AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p < threshold AND "
              "y = 0 THEN 1 END) AS tn, count(CASE WHEN p >= threshold AND y = 0 THEN 1 END) AS fp, count(CASE WHEN p < threshold "
              f"AND y = 1 THEN 1 END) AS fn FROM {source} CROSS JOIN grid GROUP BY ALL",
        "sw": f"SELECT {key}threshold, {_FOUR}, {_COSTS} FROM cf",
    }


register("threshold_sweep", sql("SELECT * FROM sw", "scored", **swept("scored")))(
    lambda spark, sf: metrics.threshold_sweep(scores(spark, sf)))
register("threshold_cross", sql("SELECT * FROM sw", "model_scores", **swept("model_scores", "model")))(
    lambda spark, sf: metrics.threshold_sweep(model_scores(spark, sf), ["model"]))
register("optimal_threshold", sql("SELECT * FROM sw ORDER BY total_cost, threshold LIMIT 1", "scored", **swept("scored")))(
    lambda spark, sf: metrics.optimal_threshold(scores(spark, sf)))

_BEST = ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY total_cost, threshold) AS rn FROM sw) "
         "WHERE rn = 1")
_EVAL = {**ranked("model_scores", "model"), **swept("model_scores", "model"), "best": _BEST,
         "ev": f"SELECT rk.*, best.* EXCLUDE (model), {_RATIOS}, {_RATES} FROM rk JOIN best USING (model)"}
register("evaluate_all", sql("SELECT * FROM ev", "model_scores", **_EVAL))(
    lambda spark, sf: metrics.evaluate_all(model_scores(spark, sf)))
register("evaluate_at_optimum", sql(
    "SELECT roc_auc, ks, brier, threshold AS opt_threshold, cost_per_applicant FROM ev WHERE model = 'scorecard'", "model_scores",
    **_EVAL))(lambda spark, sf: metrics.evaluate_at_optimum(scores(spark, sf)))
register("recommend_model", sql(
    "SELECT * FROM ev WHERE roc_auc >= (SELECT max(roc_auc) FROM ev) - 0.005e0 ORDER BY cost_per_applicant, roc_auc DESC, model LIMIT 1",
    "model_scores", **_EVAL))(lambda spark, sf: metrics.recommend_model(metrics.evaluate_all(model_scores(spark, sf))))
register("rank_table", sql(
    "SELECT CAST(row_number() OVER (ORDER BY roc_auc DESC, model) AS INTEGER) AS rank, model, roc_auc, ks FROM ev", "model_scores",
    **_EVAL))(lambda spark, sf: metrics.rank_table(
        metrics.rank_metrics(model_scores(spark, sf), ["model"]).select("model", "roc_auc", "ks"), ["roc_auc DESC", "model"]))

_EDGES = ", ".join(f"quantile_cont(p, {k / 10})" for k in range(1, 10))
register("calibration_bins", sql(
    f"SELECT CAST(len(list_filter(q, lambda e: e < p)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(p), 6) AS mean_p, "
    "round(avg(y), 6) AS fraction_positive FROM scored CROSS JOIN e GROUP BY 1", "scored", e=f"SELECT [{_EDGES}] AS q FROM scored"))(
    lambda spark, sf: metrics.calibration_bins(scores(spark, sf)))

_GAIN = ("SELECT customer_id, p, row_number() OVER o AS rank, sum(1 - y) OVER o AS found, count(*) OVER () AS n, sum(1 - y) OVER () AS t0 "
         "FROM scored WINDOW o AS (ORDER BY p, md5(concat(customer_id, '|42')), customer_id ROWS UNBOUNDED PRECEDING)")
register("gain_curve", sql(
    "SELECT customer_id, p, CAST(rank AS BIGINT) AS rank, round(rank * 1e0 / n, 6) AS population_share, round(found * 1e0 / t0, 6) AS capture FROM gain",
    "scored", gain=_GAIN))(
    lambda spark, sf: metrics.gain_curve(scores(spark, sf)).select("customer_id", "p", "rank", "population_share", "capture"))
register("lift_deciles", sql(
    "SELECT CAST(k AS INTEGER) AS decile, round((found * 1e0 / t0) / (k / 1e1), 6) AS lift FROM gain CROSS JOIN (SELECT unnest(range(1, 11)) AS k) "
    "WHERE rank = CAST(floor(n * k / 1e1) AS BIGINT)", "scored", gain=_GAIN))(
    lambda spark, sf: metrics.lift_deciles(scores(spark, sf)))
