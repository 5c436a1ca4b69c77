"""Classification metrics from one count per distinct score.

A score set has the columns (y, p) and any grouping columns, such as ``model``. ``score_counts`` counts both
classes per exact score, so a score shared by a third of all rows is one row. Every metric below starts from
those counts; running sums go through buckets between quantiles of the scores, so scores that crowd in a small
interval still spread. One rule, ``p >= threshold``, approves everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.ranking import HASH_DIGITS, prefix_sum, window
from underwright.functions.scalars import hash_order, long_rows, number

COST_FP, COST_FN = 5.0, 1.0
THRESHOLDS = 99
DECILES = 10
BUCKETS = 256  # intervals between score quantiles
#: The highest whole percent k with k / 100 <= p.
PERCENT = ("CAST(greatest(0, least(100, CASE WHEN (floor(p * 100) + 1) / 100D <= p THEN floor(p * 100) + 1 "
           "WHEN floor(p * 100) / 100D > p THEN floor(p * 100) - 1 ELSE floor(p * 100) END)) AS INT)")
GOOD = "CAST(y AS BIGINT)"


def _aggregate(df: DataFrame, by: Sequence[str], exprs: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.expr(e) for e in exprs]) if by else df.selectExpr(*exprs)


def score_counts(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per exact score as (by..., p, n1, n0). Rows without score or label do not count.

    They are dropped after the sums: a filter on p before would have the scores computed twice, for itself and for the sums.
    """
    rows = scores.selectExpr(*by, "CAST(p AS DOUBLE) AS p", f"{GOOD} AS y")
    counts = rows.groupBy(*by, "p").agg(F.expr("sum(IF(p IS NULL, NULL, y)) AS n1"), F.expr("sum(IF(p IS NULL, NULL, 1 - y)) AS n0"))
    return counts.filter("n1 IS NOT NULL")


def _in_buckets(rows: DataFrame, bucket: str, p: str = "p") -> DataFrame:
    """Append the number of score quantiles at or below p; the quantiles are one broadcast row of fixed length.

    ``p`` is the score that the quantiles are taken of; where it names all columns of ``rows``, both uses of them share one shuffle.
    Quantiles never fall, so the number is found by halving.
    """
    shares = ", ".join(f"{k / BUCKETS!r}D" for k in range(1, BUCKETS))
    edges = rows.selectExpr(f"percentile_approx({p}, array({shares}), {16 * BUCKETS}) AS _edges")
    placed = rows.join(F.broadcast(edges)).selectExpr("*", f"0 AS {bucket}")
    step = BUCKETS // 2
    while step:
        placed = placed.withColumn(bucket, F.expr(f"IF(get(_edges, {bucket} + {step - 1}) <= p, {bucket} + {step}, {bucket})"))
        step //= 2
    return placed.drop("_edges")


def _attach(df: DataFrame, row: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-group constants; without groups ``row`` has exactly one row.

    ``row`` has one row per group; a group's distinct scores that outgrow one task are split by the skew join.
    """
    return df.join(row, list(by)) if by else df.join(F.broadcast(row))


def _cumulative(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts plus inclusive running sums c1, c0 along rising p and the group totals t1, t0, as doubles."""
    groups = {f"_g{i}": f"coalesce(CAST({c} AS STRING), '')" for i, c in enumerate(by)}
    bucketed = _in_buckets(counts, "_b", "IF(n1 + n0 IS NULL, NULL, p)").selectExpr(*by, "p", "n1", "n0", "_b", *[f"{e} AS {g}" for g, e in groups.items()])
    running = prefix_sum(bucketed, {"c1": "n1", "c0": "n0"}, ["p"], ["_b"], list(groups), {"t1": "n1", "t0": "n0"})
    return running.selectExpr(
        *by, "p", *[f"CAST({c} AS DOUBLE) AS {c}" for c in ("n1", "n0", "c1", "c0", "t1", "t0")])


# --- confusion and its ratios ---------------------------------------------------------------------


def confusion(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """TP, TN, FP, FN at ``p >= threshold``; all four are present even for an absent class."""
    approved = f"p >= {number(threshold)}"
    return _aggregate(scores, by, [
        f"count_if({approved} AND y = 1) AS tp", f"count_if(NOT {approved} AND y = 0) AS tn",
        f"count_if({approved} AND y = 0) AS fp", f"count_if(NOT {approved} AND y = 1) AS fn"])


def confusion_matrix_table(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Two-by-two table (actual, predicted, n) with zeros filled in."""
    cells = (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    return long_rows(confusion(scores, threshold), [
        {"actual": str(a), "predicted": str(b), "n": c} for c, a, b in cells])


def _ratio(a: str, b: str) -> str:
    return f"round(coalesce(try_divide(CAST({a} AS DOUBLE), {b}), 0D), 4)"


# Ratios of a confusion row, 0 where the denominator is 0.
RATIOS = {
    "accuracy": _ratio("tp + tn", "tp + tn + fp + fn"),
    "precision": _ratio("tp", "tp + fp"),
    "recall": _ratio("tp", "tp + fn"),
    "f1": _ratio("2 * tp", "2 * tp + fp + fn"),
    "specificity": _ratio("tn", "tn + fp"),
}
# Share approved, and defaulters among the approved.
APPROVALS = {"approval_rate": _ratio("tp + fp", "tp + tn + fp + fn"), "bad_rate": _ratio("fp", "tp + fp")}


def _named(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in exprs.items()]


def cost_exprs(cost_fp: float = COST_FP, cost_fn: float = COST_FN) -> dict[str, str]:
    total = f"({number(cost_fp)} * fp + {number(cost_fn)} * fn)"
    return {"total_cost": total, "cost_per_applicant": _ratio(total, "tp + tn + fp + fn")}


def accuracy_precision_recall_f1_specificity(scores: DataFrame, threshold: float = 0.5,
                                             by: Sequence[str] = ()) -> DataFrame:
    return confusion(scores, threshold, by).selectExpr(*by, *_named(RATIOS))


def approval_and_bad_rate(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    return confusion(scores, threshold, by).selectExpr(*by, *_named(APPROVALS))


def business_cost(scores: DataFrame, threshold: float = 0.5, cost_fp: float = COST_FP, cost_fn: float = COST_FN,
                  by: Sequence[str] = ()) -> DataFrame:
    """Cost of approving defaulters and rejecting good applicants."""
    return confusion(scores, threshold, by).selectExpr(*by, "fp", "fn", *_named(cost_exprs(cost_fp, cost_fn)))


# --- ranking metrics ------------------------------------------------------------------------------


def rank_metrics(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware AUC, average precision, KS and Brier score per group, 6 digits.

    KS is 0 when a class is absent; AUC is NULL then. Average precision adds precision times the
    recall step of each distinct score, from the highest score down.
    """
    above1, above0 = "(t1 - c1 + n1)", "(t0 - c0 + n0)"  # rows scored p or higher
    return _aggregate(_cumulative(score_counts(scores, by), by), by, [
        "round(try_divide(sum(n1 * (c0 - n0 / 2)), max(t1 * t0)), 6) AS roc_auc",
        f"round(sum(try_divide(n1, t1) * {above1} / ({above1} + {above0})), 6) AS pr_auc",
        "round(coalesce(max(abs(try_divide(c1, t1) - try_divide(c0, t0))), 0D), 6) AS ks",
        "round(sum(n1 * (1 - p) * (1 - p) + n0 * p * p) / max(t1 + t0), 6) AS brier",
    ])


def roc_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rank_metrics(scores, by).select(*by, "roc_auc")


def pr_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rank_metrics(scores, by).select(*by, "pr_auc")


def ks(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rank_metrics(scores, by).select(*by, "ks")


def brier(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the probability; needs no order."""
    return _aggregate(scores, by, ["round(avg((p - y) * (p - y)), 6) AS brier"])


def _from_the_top(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct score: good and bad rows scored that high or higher, and totals."""
    return _cumulative(score_counts(scores, by), by).selectExpr(
        *by, "p", "n1", "n0", "t1 - c1 + n1 AS tp", "t0 - c0 + n0 AS fp", "t1", "t0")


def roc_points(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score; ``random_tpr`` is the diagonal."""
    return _from_the_top(scores, by).selectExpr(
        *by, "p AS threshold", "round(try_divide(fp, t0), 6) AS fpr", "round(try_divide(tp, t1), 6) AS tpr",
        "round(try_divide(fp, t0), 6) AS random_tpr")


def pr_points(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) at each distinct score, next to the base rate."""
    return _from_the_top(scores, by).selectExpr(
        *by, "p AS threshold", "round(tp / (tp + fp), 6) AS precision", "round(try_divide(tp, t1), 6) AS recall",
        "round(t1 / (t1 + t0), 6) AS base_rate")


def pr_auc_trapezoid(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall points; the curve starts at precision 1, recall 0.

    The point before a score is the one of the next higher score, whose counts are this row's
    without its own rows, so no lag over the whole set is needed.
    """
    before = "coalesce(try_divide(tp - n1, tp - n1 + fp - n0), 1D)"
    return _aggregate(_from_the_top(scores, by), by, [
        f"round(sum(try_divide(n1, t1) * (tp / (tp + fp) + {before}) / 2), 6) AS pr_auc_trapezoid"])


# --- thresholds -----------------------------------------------------------------------------------


def threshold_sweep(scores: DataFrame, by: Sequence[str] = (), cost_fp: float = COST_FP,
                    cost_fn: float = COST_FN) -> DataFrame:
    """Confusion counts and cost at 0.01 .. 0.99, from one histogram of whole percents per group.

    A score counts as approved for every threshold up to its whole percent, so 101 cells per group,
    summed from the score counts, hold all that is needed; no row meets 99 thresholds.
    """
    return _sweep(score_counts(scores, by), by, cost_fp, cost_fn)


def _sweep(counts: DataFrame, by: Sequence[str], cost_fp: float, cost_fn: float) -> DataFrame:
    hist = counts.selectExpr(*by, f"{PERCENT} AS k", "n1", "n0").groupBy(*by, "k").agg(
        F.expr("sum(n1) AS n1"), F.expr("sum(n0) AS n0"))
    # at most 101 cells per group, laid out over the whole grid
    packed = _aggregate(hist, by, ["map_from_entries(collect_list(struct(k, struct(n1, n0)))) AS m"]).filter("size(m) > 0")
    cells = packed.selectExpr(*by, "m", f"explode(sequence(0, {THRESHOLDS + 1})) AS k").selectExpr(
        *by, "k", "coalesce(try_element_at(m, k).n1, 0L) AS n1", "coalesce(try_element_at(m, k).n0, 0L) AS n0")
    below = window(by, ["k"], "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")  # 101 rows per group
    swept = cells.selectExpr(
        *by, "k", f"coalesce(sum(n1) {below}, 0L) AS fn", f"coalesce(sum(n0) {below}, 0L) AS tn",
        f"sum(n1) {window(by, [])} AS t1", f"sum(n0) {window(by, [])} AS t0")
    return swept.filter(f"k BETWEEN 1 AND {THRESHOLDS}").selectExpr(
        *by, "k / 100D AS threshold", "t1 - fn AS tp", "tn", "t0 - tn AS fp", "fn").selectExpr(
        "*", *_named(cost_exprs(cost_fp, cost_fn)))


def optimal_threshold(scores: DataFrame, by: Sequence[str] = (), cost_fp: float = COST_FP,
                      cost_fn: float = COST_FN) -> DataFrame:
    """Cheapest threshold per group; the lowest one wins a tie."""
    columns = ("threshold", "total_cost", "cost_per_applicant", "tp", "tn", "fp", "fn")
    best = _aggregate(threshold_sweep(scores, by, cost_fp, cost_fn), by, [
        "min(struct(total_cost, threshold, cost_per_applicant, tp, tn, fp, fn)) AS b"])
    return best.selectExpr(*by, *[f"b.{c}" for c in columns])


def metric_suite(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Every metric of a score set in one row per group, all from the score counts."""
    approved = f"p >= {number(threshold)}"
    points = _aggregate(score_counts(scores, by), by, [
        f"sum(IF({approved}, n1, 0L)) AS tp", f"sum(IF({approved}, 0L, n0)) AS tn",
        f"sum(IF({approved}, n0, 0L)) AS fp", f"sum(IF({approved}, 0L, n1)) AS fn"])
    points = points.selectExpr(*by, f"{number(threshold)} AS threshold", "tp", "tn", "fp", "fn",
                               *_named({**RATIOS, **APPROVALS}))
    return _attach(points, rank_metrics(scores, by), by)


def evaluate_all(scores: DataFrame, by: str = "model", cost_fp: float = COST_FP, cost_fn: float = COST_FN) -> DataFrame:
    """All models: ranking metrics, and the point metrics at each model's cheapest threshold, best AUC first."""
    best = optimal_threshold(scores, [by], cost_fp, cost_fn).selectExpr("*", *_named({**RATIOS, **APPROVALS}))
    return rank_metrics(scores, [by]).join(best, by).orderBy(F.desc("roc_auc"), by)


def evaluate_at_optimum(scores: DataFrame, cost_fp: float = COST_FP, cost_fn: float = COST_FN) -> DataFrame:
    """AUC, KS, Brier and cost at the cheapest threshold of one score set."""
    return evaluate_all(scores.selectExpr("'m' AS model", "y", "p"), "model", cost_fp, cost_fn).selectExpr(
        "roc_auc", "ks", "brier", "threshold AS opt_threshold", "cost_per_applicant")


def rank_table(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """Result table (one row per model or feature) with a 1-based rank in front."""
    return table.selectExpr(f"row_number() {window([], order)} AS rank", "*")


def recommend_model(evaluated: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Cheapest model among those within ``tolerance`` of the best AUC."""
    near = evaluated.selectExpr("*", "max(roc_auc) OVER () AS _best").filter(  # one row per model
        f"roc_auc >= _best - {number(tolerance)}").drop("_best")
    return near.orderBy("cost_per_applicant", F.desc("roc_auc"), "model").limit(1)


# --- calibration, gain and lift -------------------------------------------------------------------


def score_quantiles(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles of p per group, as an array ``q``, from the score counts."""
    rows = _cumulative(counts, by).selectExpr(
        *by, "p", "t1 + t0 AS n", "c1 + c0 - n1 - n0 AS first", "c1 + c0 - 1 AS last")
    picks, values = ["max(n) AS n"], []
    for i, q in enumerate(probs):
        position = f"((n - 1) * {number(q)})"
        for end, rank in (("lo", f"floor({position})"), ("hi", f"ceil({position})")):
            picks.append(f"max(IF({rank} BETWEEN first AND last, p, NULL)) AS {end}{i}")
        values.append(f"lo{i} + (hi{i} - lo{i}) * ({position} - floor({position}))")
    return _aggregate(rows, by, picks).selectExpr(*by, f"array({', '.join(values)}) AS q")


def calibration_bins(scores: DataFrame, by: Sequence[str] = (), bins: int = DECILES) -> DataFrame:
    """Quantile bins of p: rows, mean score and share of good rows; empty bins are left out."""
    counts = score_counts(scores, by)
    edges = score_quantiles(counts, [i / bins for i in range(1, bins)], by)
    located = _attach(counts, edges, by).selectExpr(
        *by, "p", "n1", "n1 + n0 AS n", "size(filter(q, e -> e < p)) AS bin")
    return located.groupBy(*by, "bin").agg(*[F.expr(e) for e in (
        "sum(n) AS n", "round(sum(p * n) / sum(n), 6) AS mean_p", "round(sum(n1) / sum(n), 6) AS fraction_positive")]
    )


def gain_curve(scores: DataFrame, id_col: str = "customer_id", seed: int = 42) -> DataFrame:
    """Riskiest first: rank, population share and share of defaulters found so far, per applicant.

    Equal scores are ordered by the seeded hash of the id, and its first digits split a score that
    many rows share, so no window holds such a group whole.
    """
    rows = scores.filter("p IS NOT NULL AND y IS NOT NULL").selectExpr(
        id_col, "coalesce(CAST(p AS DOUBLE), 0D) AS p", f"1 - {GOOD} AS bad", "1L AS one", f"{hash_order(id_col, seed)} AS h")
    rows = _in_buckets(rows, "b0").selectExpr("*", f"substring(h, 1, {HASH_DIGITS}) AS b1")
    ranked = prefix_sum(rows, {"rank": "one", "found": "bad"}, ["h", id_col], ["b0", "p", "b1"], (), {"n": "one", "t0": "bad"})
    return ranked.selectExpr(
        id_col, "p", "rank", "round(rank / n, 6) AS population_share", "round(try_divide(found, t0), 6) AS capture",
        "n", "found", "t0")


def lift_deciles(scores: DataFrame, id_col: str = "customer_id", seed: int = 42, parts: int = DECILES) -> DataFrame:
    """Cumulative lift at the end of each tenth: defaulters found there over the share of rows seen."""
    marks = ", ".join(f"CAST(floor(n * {k} / {parts}) AS BIGINT)" for k in range(1, parts + 1))
    curve = gain_curve(scores, id_col, seed).selectExpr(
        "found", "t0", f"CAST(array_position(array({marks}), rank) AS INT) AS decile")
    return curve.filter("decile > 0").selectExpr(
        "decile", f"round(try_divide(try_divide(found, t0), decile / {number(parts)}), 6) AS lift")
