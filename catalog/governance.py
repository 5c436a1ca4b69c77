"""Queries on calibration, stability, fairness, expected loss, drift, pruned scorecards and challengers."""

from __future__ import annotations

from catalog.flows import _decisions
from catalog.models import split_cleaned
from catalog.quality import ranked
from catalog.registry import cleaned, raw, register, round_doubles, scores
from catalog.rows import _CARD_SQL
from catalog.selection import _NAMES, _TR, OUTPUT_NAMES, matrix_rows
from catalog.sql import NUMERIC, r, sql, stacked
from catalog.tables import SPLIT_SQL
from underwright.operators import blend, calibration, portfolio, selection, stability
from underwright.session import materialise, scratch_path
from underwright.sources import scorecard as card
from underwright.sources.applicants import table
from underwright.streaming import drift

# --- calibration ----------------------------------------------------------------------------------

_PERCENTS = "SELECT round(p, 2) AS k, count(*) AS n, sum(y) AS good FROM scored WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1"
_MEANS = ("SELECT a.k AS a, b.k AS b, sum(c.good) * 1e0 / sum(c.n) AS mean FROM cells a JOIN cells b ON a.k <= b.k JOIN cells c ON c.k BETWEEN a.k AND b.k GROUP BY 1, 2")
#: The isotonic value of x is the largest, over a <= x, of the smallest mean from a to any b >= x.
_ISOTONIC = ("SELECT k, n, good, max(least_mean) AS value FROM (SELECT c.k, c.n, c.good, m.a, min(m.mean) AS least_mean FROM cells c JOIN means m ON m.a <= c.k AND m.b >= c.k "
             "GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
_ISO = {"cells": _PERCENTS, "means": _MEANS, "iso": _ISOTONIC}


@register("isotonic_calibration", sql(f"SELECT k AS p, CAST(n AS BIGINT) AS n, {r('value')} AS calibrated FROM iso", "scored", **_ISO))
def _isotonic_calibration(spark, sf):
    """The calibrated value of every whole percent that occurs."""
    rows = materialise(scores(spark, sf), "scores")
    steps = calibration.calibration_steps(calibration.isotonic_blocks(rows, 2))
    counts = calibration.rounded_counts(rows, 2)
    return round_doubles(counts.select("p", "n", calibration.calibrated_by_steps("p", steps).alias("calibrated")))


register("isotonic_blocks", sql(
    f"SELECT min(k) AS low, max(k) AS high, CAST(sum(n) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good, {r('value')} AS calibrated FROM iso GROUP BY value", "scored", **_ISO))(
    lambda spark, sf: round_doubles(calibration.isotonic_blocks(scores(spark, sf), 2)))

_TINY = "greatest(1e-6, least({}, 1e0 - 1e-6))".format
_ODDS = f"ln({_TINY('p')} / (1e0 - {_TINY('p')}))"
_Q = "1e0 / (1e0 + exp(-(a * x + b)))"
_PLATT = (
    ", newton AS (SELECT 0 AS step, 1e0 AS a, 0e0 AS b UNION ALL SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM ("
    "SELECT step, any_value(a) AS a, any_value(b) AS b, sum((n1 + n0) * q - n1 * hi - n0 * lo) AS gb, sum(((n1 + n0) * q - n1 * hi - n0 * lo) * x) AS ga, "
    "sum((n1 + n0) * q * (1 - q)) AS hbb, sum((n1 + n0) * q * (1 - q) * x) AS hab, sum((n1 + n0) * q * (1 - q) * x * x) AS haa FROM ("
    f"SELECT step, a, b, x, n1, n0, hi, lo, {_Q} AS q FROM newton, points, targets WHERE step < {calibration.STEPS}) GROUP BY step)), "
    f"fit AS (SELECT a, b FROM newton WHERE step = {calibration.STEPS}) ")
_POINTS = {"points": f"SELECT {_ODDS} AS x, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM scored GROUP BY p",
           "targets": "SELECT (sum(n1) + 1) / (sum(n1) + 2) AS hi, 1 / (sum(n0) + 2) AS lo FROM points"}


def _recursive(select: str, **extra: str) -> str:
    """SQL with the Newton steps as a recursive CTE before the last SELECT."""
    head = sql("@@", "scored", **_POINTS, **extra)
    return head.replace("WITH ", "WITH RECURSIVE ", 1).replace(" @@", _PLATT + select)


@register("platt_calibration", _recursive(f"SELECT {r('a')} AS a, {r('b')} AS b FROM fit"))
def _platt_calibration(spark, sf):
    a, b = calibration.platt_fit(scores(spark, sf))
    return round_doubles(spark.createDataFrame([(a, b)], "a double, b double"))


_LOSS = "round(avg((q - y) * (q - y)), 6) AS brier, round(-avg(y * ln({t}) + (1 - y) * ln(1 - {t})), 6) AS log_loss".format(t=_TINY("q"))
register("calibration_report", _recursive(
    f"SELECT 'none' AS method, {_LOSS} FROM (SELECT y, p AS q FROM scored) UNION ALL SELECT 'platt', {_LOSS} FROM (SELECT y, {_Q} AS q FROM (SELECT y, {_ODDS} AS x FROM scored), fit) "
    f"UNION ALL SELECT 'isotonic', {_LOSS} FROM (SELECT s.y, i.value AS q FROM scored s JOIN iso i ON i.k = round(s.p, 2))", **_ISO))(
    lambda spark, sf: _calibration_report(materialise(scores(spark, sf), "scores")))


def _calibration_report(rows):
    """Isotonic on whole percents, as the SQL's formula has them; the others on exact scores."""
    return calibration.calibration_report(rows).filter("method <> 'isotonic'").unionByName(calibration.calibration_report(rows, digits=2).filter("method = 'isotonic'"))


# --- stability ------------------------------------------------------------------------------------

_WATCHED = ("p", *NUMERIC)
_TWO = "SELECT c.*, sc.p, s.split FROM cleaned c JOIN s USING (customer_id) JOIN scored sc USING (customer_id)"
_EDGES = stacked(_WATCHED, "SELECT '{c}' AS \"column\", list_sort(list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM two WHERE split = 'train'")
_LONG = stacked(_WATCHED, "SELECT '{c}' AS \"column\", split, {c} AS v FROM two WHERE split <> 'test'")
_BINNED = ("SELECT \"column\", split, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(edges, lambda e: v > e)) END AS bin FROM long JOIN edges USING (\"column\")")
_SHARES = ("SELECT g.\"column\", g.bin, g.upper, count(b.bin) FILTER (b.split = 'train') AS expected_n, count(b.bin) FILTER (b.split = 'validation') AS actual_n FROM ("
           "SELECT \"column\", bin, CASE WHEN bin >= 0 THEN edges[bin + 1] END AS upper FROM (SELECT \"column\", edges, unnest(range(-1, len(edges) + 1)) AS bin FROM edges)) g "
           "LEFT JOIN binned b ON b.\"column\" = g.\"column\" AND b.bin = g.bin GROUP BY 1, 2, 3")
_PARTS = ("SELECT *, greatest(1e-4, expected_n * 1e0 / sum(expected_n) OVER w) AS expected_share, greatest(1e-4, actual_n * 1e0 / sum(actual_n) OVER w) AS actual_share FROM shares WINDOW w AS (PARTITION BY \"column\")")
_PSI = {"s": SPLIT_SQL.format(val=0.2), "two": _TWO, "edges": _EDGES, "long": _LONG, "binned": _BINNED, "shares": _SHARES, "parts": _PARTS}
_PART = "(actual_share - expected_share) * ln(actual_share / expected_share)"


def _two(spark, sf):
    """Training and validation rows with their scores."""
    rows = split_cleaned(spark, sf).join(scores(spark, sf).select("customer_id", "p"), "customer_id")
    rows = materialise(rows.select("split", *_WATCHED), "two")
    return rows.filter("split = 'train'"), rows.filter("split = 'validation'")


register("population_stability", sql(
    "SELECT \"column\", n_bins, psi, CASE WHEN psi < 0.1e0 THEN 'stable' WHEN psi < 0.25e0 THEN 'moderate' ELSE 'shifted' END AS verdict FROM ("
    f"SELECT \"column\", CAST(count(*) AS INTEGER) AS n_bins, {r(f'sum({_PART})')} AS psi FROM parts GROUP BY 1)", "cleaned", "scored", **_PSI))(
    lambda spark, sf: stability.population_stability(*_two(spark, sf), _WATCHED))
register("stability_bins", sql(
    "SELECT \"column\", CAST(bin AS INTEGER) AS bin, " + r("upper") + " AS upper, CAST(expected_n AS BIGINT) AS expected_n, CAST(actual_n AS BIGINT) AS actual_n, "
    f"{r('expected_share')} AS expected_share, {r('actual_share')} AS actual_share, {r(_PART)} AS part FROM parts", "cleaned", "scored", **_PSI))(
    lambda spark, sf: round_doubles(stability.stability_bins(*_two(spark, sf), _WATCHED)))

# --- fairness and loss ----------------------------------------------------------------------------

_GROUPED = ("SELECT concat_ws('+', CASE WHEN grouping(gender) = 0 THEN 'gender' END, CASE WHEN grouping(marital_status) = 0 THEN 'marital_status' END) AS \"grouping\", gender, marital_status, count(*) AS n, "
            "count(*) FILTER (p >= 0.64e0) AS approved, count(*) FILTER (y = 1) AS n_good, count(*) FILTER (y = 1 AND p >= 0.64e0) AS good_approved FROM scored JOIN cleaned USING (customer_id) "
            "GROUP BY GROUPING SETS ((gender), (marital_status), (gender, marital_status))")
_RATES = ("SELECT *, approved * 1e0 / n AS approval, good_approved * 1e0 / nullif(n_good, 0) AS opportunity, max(CASE WHEN n >= 30 THEN approved * 1e0 / n END) OVER w AS best, "
          "max(CASE WHEN n_good >= 30 THEN good_approved * 1e0 / n_good END) OVER w AS best_good FROM grouped WINDOW w AS (PARTITION BY \"grouping\")")
register("fairness_gaps", sql(
    "SELECT \"grouping\", gender, marital_status, CAST(n AS BIGINT) AS n, CAST(n_good AS BIGINT) AS n_good, round(approval, 6) AS approval_rate, round(opportunity, 6) AS true_positive_rate, "
    "CASE WHEN n >= 30 THEN round(approval / nullif(best, 0), 6) END AS adverse_impact_ratio, CASE WHEN n >= 30 THEN round(approval - best, 6) + 0e0 END AS parity_difference, "
    "CASE WHEN n_good >= 30 THEN round(opportunity - best_good, 6) + 0e0 END AS opportunity_difference, CASE WHEN n >= 30 THEN approval / nullif(best, 0) < 0.8e0 END AS below_four_fifths FROM rates",
    "scored", "cleaned", grouped=_GROUPED, rates=_RATES))(
    lambda spark, sf: portfolio.fairness_gaps(
        scores(spark, sf).join(cleaned(spark, sf).select("customer_id", "gender", "marital_status"), "customer_id"), [["gender"], ["marital_status"], ["gender", "marital_status"]], 0.64))

_TIERS = ("CASE WHEN 1 - p < 0.05e0 THEN 'Low Risk' WHEN 1 - p < 0.15e0 THEN 'Medium Risk' WHEN 1 - p < 0.3e0 THEN 'High Risk' ELSE 'Very High Risk' END")
_CENTS = "CAST(floor({} * 100 + 0.5e0) AS BIGINT)".format
register("expected_loss", sql(
    "SELECT CASE above WHEN 0 THEN 'purpose' WHEN 1 THEN 'tier' ELSE 'total' END AS level, risk_tier, loan_purpose, CAST(n AS BIGINT) AS n, CAST(n_missing AS BIGINT) AS n_missing, exposure / 1e2 AS exposure, "
    "loss / 1e2 AS expected_loss, round((loss / 1e2) / nullif(exposure / 1e2, 0), 6) AS loss_rate FROM (SELECT grouping(risk_tier, loan_purpose) AS above, risk_tier, loan_purpose, count(*) AS n, "
    f"count(*) FILTER (loan_amount IS NULL) AS n_missing, CAST(coalesce(sum({_CENTS('loan_amount')}), 0) AS DOUBLE) AS exposure, CAST(coalesce(sum({_CENTS('(1e0 - p) * 0.45e0 * loan_amount')}), 0) AS DOUBLE) AS loss FROM ("
    f"SELECT {_TIERS} AS risk_tier, loan_purpose, p, loan_amount FROM scored JOIN cleaned USING (customer_id)) GROUP BY ROLLUP (risk_tier, loan_purpose))", "scored", "cleaned"))(
    lambda spark, sf: portfolio.expected_loss(scores(spark, sf).join(cleaned(spark, sf).select("customer_id", "loan_amount", "loan_purpose"), "customer_id")).selectExpr(
        "level", "risk_tier", "loan_purpose", "n", "n_missing", "CAST(exposure AS DOUBLE) AS exposure", "CAST(expected_loss AS DOUBLE) AS expected_loss", "loss_rate"))

# --- drift ----------------------------------------------------------------------------------------

_FEED = ("SELECT e.ts, s.p FROM events e JOIN (SELECT CAST(substring(customer_id, 4, 7) AS BIGINT) AS user_id, p FROM scored) s ON s.user_id = e.user_id")
_SCORE_EDGES = "SELECT list_sort(list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM scored"
_DRIFT = {
    "feed": _FEED, "e": _SCORE_EDGES, "bins": "SELECT unnest(range(-1, len(edges) + 1)) AS bin FROM e",
    "ref": "SELECT b.bin, greatest(1e-4, count(x.bin) * 1e0 / (SELECT count(*) FROM scored)) AS share FROM bins b LEFT JOIN (SELECT CASE WHEN p IS NULL THEN -1 ELSE len(list_filter(edges, lambda k: p > k)) END AS bin FROM scored, e) x ON x.bin = b.bin GROUP BY 1",
    "hours": "SELECT date_trunc('hour', ts) AS w, CASE WHEN p IS NULL THEN -1 ELSE len(list_filter(edges, lambda k: p > k)) END AS bin, count(*) AS n FROM feed, e GROUP BY 1, 2",
    "sums": "SELECT w, sum(n) AS n FROM hours GROUP BY 1",
    "psi": "SELECT s.w, any_value(s.n) AS n, sum((greatest(1e-4, coalesce(h.n, 0) * 1e0 / s.n) - ref.share) * ln(greatest(1e-4, coalesce(h.n, 0) * 1e0 / s.n) / ref.share)) AS psi FROM sums s, ref "
           "LEFT JOIN hours h ON h.w = s.w AND h.bin = ref.bin GROUP BY 1",
}
_DRIFT["psi"] = _DRIFT["psi"].replace("FROM sums s, ref ", "FROM sums s CROSS JOIN ref ")
_DRIFT_SQL = f"SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(n AS BIGINT) AS n, {r('psi')} AS psi FROM psi {{where}}"


def _requests(spark, sf):
    """(ts, p): each event asks for the customer of its user's number."""
    asked = scores(spark, sf).selectExpr("CAST(substring(customer_id, 4, 7) AS BIGINT) AS user_id", "p")
    return table(spark, sf, "events").selectExpr("CAST(ts AS timestamp) AS ts", "user_id").join(asked, "user_id").select("ts", "p")


def _windows(df):
    return df.selectExpr("date_format(window_start, 'yyyy-MM-dd HH:mm:ss') AS window_start", "n", "psi")


register("score_drift", sql(_DRIFT_SQL.format(where=""), "scored", **_DRIFT))(
    lambda spark, sf: _windows(drift.score_drift(_requests(spark, sf), drift.drift_reference(materialise(scores(spark, sf), "scores")))))


@register("score_drift_stream", sql(_DRIFT_SQL.format(
    where="WHERE w + INTERVAL 1 HOUR < (SELECT date_trunc('hour', max(ts)) FROM feed) - INTERVAL 10 MINUTE"), "scored", **_DRIFT))
def _score_drift_stream(spark, sf):
    """Closed windows of a feed that arrives in three parts; the query ends after the second and is started again from its checkpoint."""
    feed, out, checkpoint = (scratch_path(spark, k) for k in ("feed", "out", "chk"))
    reference = drift.drift_reference(materialise(scores(spark, sf), "scores"))
    requests = materialise(_requests(spark, sf), "requests")
    first, last = requests.selectExpr("min(ts)", "max(ts)").first()
    cuts = [first, first + (last - first) / 3, first + 2 * (last - first) / 3]

    def part(k: int) -> None:
        upper = f" AND ts < TIMESTAMP '{cuts[k + 1]}'" if k < 2 else ""
        requests.filter(f"ts >= TIMESTAMP '{cuts[k]}'{upper}").write.mode("append").parquet(feed)

    def run() -> None:
        stream = spark.readStream.schema("ts timestamp, p double").option("maxFilesPerTrigger", 1000).parquet(feed)
        closed = drift.score_drift_stream(stream, reference)
        closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for k in range(3):
        part(k)
        if k:
            run()
    return _windows(spark.read.schema(drift.DRIFT).parquet(out))


# --- scorecards and challengers -------------------------------------------------------------------


_THREE = ("credit_utilization_ratio", "risk_index", "dti_ratio")
_TRIPLE = ("SELECT corr(x1, x2) AS r12, corr(x1, x3) AS r13, corr(x2, x3) AS r23 FROM (SELECT "
           + ", ".join(f"{dict(zip(_NAMES, OUTPUT_NAMES))[c]} AS x{k}" for k, c in enumerate(_THREE, 1)) + " FROM tm)")
_VIFS = ("SELECT unnest([1, 2, 3]) AS k, unnest([1 - r23 * r23, 1 - r13 * r13, 1 - r12 * r12]) / (1 - r12 * r12 - r13 * r13 - r23 * r23 + 2 * r12 * r13 * r23) AS vif, "
         "unnest([r23, r13, r12]) AS other FROM triple")


def _vif_prune(spark, sf):
    return round_doubles(selection.vif_prune(matrix_rows(spark, sf)[0], _THREE, 1.2)[1], 4)


# three columns have closed forms: the largest VIF of all three, then the one VIF that the two left share
_LEFT = "1 / (1 - rest * rest)"
register("vif_prune", sql(
    "SELECT [" + ", ".join(f"'{c}'" for c in _THREE) + f"][k] AS feature, CAST(CASE WHEN k = worst THEN 1 WHEN {_LEFT} > 1.2e0 AND k = last THEN 2 END AS INTEGER) AS dropped, "
    + r(f"CASE WHEN k = worst THEN vif WHEN {_LEFT} > 1.2e0 AND k <> last THEN 1 ELSE {_LEFT} END", 4)
    + " AS vif FROM vifs, (SELECT arg_max(k, vif) AS worst, arg_max(other, vif) AS rest, CASE arg_max(k, vif) WHEN 3 THEN 2 ELSE 3 END AS last FROM vifs)",
    "features", **_TR, triple=_TRIPLE, vifs=_VIFS))(_vif_prune)


@register("vif_pruned_scorecard")
def _vif_pruned_scorecard(spark, sf):
    """Order of the drops, last VIFs and the logistic weights of the survivors over the whole matrix."""
    return round_doubles(selection.pruned_scorecard(*matrix_rows(spark, sf)), 4)


_CHALLENGER = "1e0 / (1e0 + exp(-(0.5e0 - 2e0 * (util - 0.5e0) - 1e0 * (dti - 0.2e0))))"
_PAIRS = f"SELECT s.customer_id, s.y, s.p AS champion, round({_CHALLENGER}, 6) AS challenger FROM scored s JOIN card USING (customer_id)"
_WEIGHTS = ("SELECT (bb * ay - ab * by_) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb FROM (SELECT sum(champion * champion) AS aa, sum(champion * challenger) AS ab, "
            "sum(challenger * challenger) AS bb, sum(champion * y) AS ay, sum(challenger * y) AS by_ FROM pairs)")
_STACKED = ("SELECT 'champion' AS model, y, champion AS p FROM pairs UNION ALL SELECT 'challenger', y, challenger FROM pairs UNION ALL "
            "SELECT 'blend', y, round(greatest(0e0, least(1e0, wa * champion + wb * challenger)), 6) + 0e0 FROM pairs, wts")
register("champion_challenger", sql(
    "SELECT model, round(CASE model WHEN 'champion' THEN wa WHEN 'challenger' THEN wb ELSE wa + wb END, 6) + 0e0 AS weight, roc_auc, ks, brier FROM rk, wts", "scored", "dedup",
    card=_CARD_SQL, pairs=_PAIRS, wts=_WEIGHTS, stacked=_STACKED, **ranked("stacked", "model")))(lambda spark, sf: _challenge(spark, sf))


def _challenge(spark, sf):
    """The fixed scorecard against one that knows utilisation and debt alone."""
    inputs = materialise(card.scorecard_inputs(raw(spark, sf)), "inputs")
    champion, challenger = (inputs.selectExpr("customer_id", "creditworthy AS y", f"{p} AS p") for p in (card.probability(), card.probability({"score": "600D", "pc": "0.9D"})))
    return blend.champion_challenger(champion, challenger)
