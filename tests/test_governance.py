"""Calibration, stability, drift, fairness, loss, pruned scorecards and challengers against plain Python and NumPy."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest

from underwright.operators import blend, calibration, portfolio, selection, stability
from underwright.session import scratch_path
from underwright.streaming import drift


def scored(spark, rows, more=""):
    return spark.createDataFrame(rows, "customer_id string, y int, p double" + more)


def isotonic(cells):
    """Largest, over a <= x, of the smallest mean from a to any b >= x."""
    n, good = np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
    means = [[good[a : b + 1].sum() / n[a : b + 1].sum() if a <= b else math.inf for b in range(len(cells))] for a in range(len(cells))]
    return [max(min(means[a][x:]) for a in range(x + 1)) for x in range(len(cells))]


@pytest.mark.parametrize("seed", range(4))
def test_pooling_in_any_tree(seed):
    rng = random.Random(seed)
    cells = [(k / 100, n := rng.randint(1, 9), rng.randint(0, n)) for k in range(60)]
    blocks = [(p, p, n, g) for p, n, g in cells]
    whole = calibration.pooled(blocks)
    cuts = sorted(rng.sample(range(1, 60), 7))
    parts = [calibration.pooled(blocks[a:b]) for a, b in zip([0, *cuts], [*cuts, 60])]
    assert calibration.pooled([b for part in parts for b in part]) == whole
    values = [next(b[3] / b[2] for b in whole if b[0] <= p <= b[1]) for p, _, _ in cells]
    assert values == pytest.approx(isotonic(cells))


def test_isotonic_odd_scores(spark):
    rng = random.Random(9)
    rows = [("a", rng.random() < k / 3000, round(k / 3000, 3)) for k in range(3000)] + [("b", None, 0.5), ("c", True, None), ("d", False, 1.0), ("e", True, 0.0)] + [("hot", k % 3 > 0, 0.5) for k in range(1500)]
    frame = scored(spark, [(i, None if y is None else int(y), p) for i, y, p in rows])
    blocks = calibration.isotonic_blocks(frame, 3).orderBy("low").collect()
    counts = {}
    for _, y, p in rows:
        if y is not None and p is not None:
            n, good = counts.get(round(p, 3), (0, 0))
            counts[round(p, 3)] = (n + 1, good + int(y))
    cells = [(p, *c) for p, c in sorted(counts.items())]
    assert [r["calibrated"] for r in blocks] == sorted({r["calibrated"] for r in blocks}) and sum(r["n"] for r in blocks) == len(rows) - 2
    steps = calibration.calibration_steps(calibration.isotonic_blocks(frame, 3))
    low = [s[0] for s in steps]
    got = [steps[np.searchsorted(low, p, side="right") - 1][1] for p, _, _ in cells]
    assert got == pytest.approx(isotonic(cells))
    new = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (None,)], "p double").select(calibration.calibrated_by_steps("p", steps).alias("c")).collect()
    assert (new[0]["c"], new[2]["c"], new[3]["c"]) == (steps[0][1], steps[-1][1], None)
    none = frame.limit(0)
    assert calibration.isotonic_blocks(none).count() == 0 and calibration.isotonic_calibrated(frame, none).filter("p IS NOT NULL").count() == 0


def newton(rows, steps=calibration.STEPS):
    p, y = (np.array(c, dtype=float) for c in zip(*rows))
    p = np.clip(np.round(p, 6), 1e-6, 1 - 1e-6)
    x, good = np.log(p / (1 - p)), y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(-(a * x + b)))
        w = q * (1 - q)
        move = np.linalg.solve([[np.sum(w * x * x), np.sum(w * x)], [np.sum(w * x), np.sum(w)]], [np.sum((q - target) * x), np.sum(q - target)])
        a, b = a - move[0], b - move[1]
    return a, b


def test_platt(spark):
    rng = random.Random(4)
    rows = [(p := rng.random(), int(rng.random() < 1 / (1 + math.exp(-(0.5 * math.log(p / (1 - p)) - 1))))) for _ in range(3000)]
    frame = scored(spark, [("x", y, p) for p, y in rows])
    a, b = calibration.platt_fit(frame)
    assert (a, b) == pytest.approx(newton(rows), abs=1e-6) and a == pytest.approx(0.5, abs=0.1) and b == pytest.approx(-1, abs=0.15)
    report = {r["method"]: r for r in calibration.calibration_report(frame).collect()}
    assert report["isotonic"]["brier"] <= report["platt"]["brier"] < report["none"]["brier"]
    separable = scored(spark, [("x", int(k > 50), k / 100) for k in range(101)])
    assert all(map(math.isfinite, calibration.platt_fit(separable)))
    one = calibration.platt_fit(scored(spark, [("x", k % 2, 0.5) for k in range(10)]))
    assert one == pytest.approx((1.0, 0.0)) and calibration.platt_fit(frame.limit(0)) is None and calibration.platt_calibrated(frame, frame.limit(0)).collect() == frame.collect()


def test_stability(spark):
    expected = spark.createDataFrame([(float(k % 100), None if k % 4 else 1.0, 7.0) for k in range(1000)], "x double, gap double, same double")
    moved = spark.createDataFrame([(float(k % 100) + 30, None, 7.0) for k in range(500)], "x double, gap double, same double")
    index = {r["column"]: r for r in stability.population_stability(expected, moved, ["x", "gap", "same"]).collect()}
    edges = np.quantile(np.arange(1000) % 100, np.arange(1, 10) / 10)
    e, a = (np.maximum(1e-4, np.bincount(np.searchsorted(edges, v, side="left"), minlength=10) / len(v)) for v in (np.arange(1000) % 100, np.arange(500) % 100 + 30))
    missing = 0.0  # neither has any
    assert index["x"]["psi"] == pytest.approx(np.sum((a - e) * np.log(a / e)) + missing, abs=1e-6) and index["x"]["verdict"] == "shifted" and index["x"]["n_bins"] == 11
    assert index["same"]["psi"] == 0 and index["same"]["verdict"] == "stable" and index["gap"]["verdict"] == "shifted"
    assert all(math.isfinite(r["psi"]) for frames in ((expected, moved.limit(0)), (expected.limit(0), moved)) for r in stability.population_stability(*frames, ["x", "gap"]).collect())
    assert {r["psi"] for r in stability.population_stability(expected, expected, ["x", "gap", "same"]).collect()} == {0.0}


def test_fairness_small_groups(spark):
    rows = [("a", int(k % 2 == 0), 0.9 if k % 4 else 0.1, "F", "x") for k in range(100)] + [("b", 1, 0.9 if k % 2 else 0.1, "M", "x") for k in range(60)]
    rows += [("c", 1, 0.9, None, "y") for _ in range(5)] + [("d", 0, None, "F", "x"), ("e", None, 0.9, "M", None)]
    got = {(r["grouping"], r["g"], r["h"]): r for r in portfolio.fairness_gaps(scored(spark, rows, ", g string, h string"), [["g"], ["g", "h"]]).collect()}
    few, women, men = got["g", "(missing)", None], got["g", "F", None], got["g", "M", None]
    assert (few["n"], few["approval_rate"], few["adverse_impact_ratio"], few["parity_difference"], few["below_four_fifths"]) == (5, 1.0, None, None, None)
    assert (women["n"], women["n_good"], women["approval_rate"], women["adverse_impact_ratio"], women["parity_difference"]) == (100, 50, 0.75, 1.0, 0.0)
    assert men["approval_rate"] == pytest.approx(31 / 61, abs=1e-6) and men["adverse_impact_ratio"] == pytest.approx(31 / 61 / 0.75, abs=1e-6) and men["below_four_fifths"]
    assert (women["true_positive_rate"], men["opportunity_difference"], got["g+h", "M", "(missing)"]["n"]) == (0.5, 0.0, 1)
    assert portfolio.fairness_gaps(scored(spark, rows, ", g string, h string").limit(0), [["g"]]).count() == 0


def test_expected_loss(spark):
    rows = [("a", 1, 0.97, 1000.0, "Home"), ("b", 1, 0.97, 2000.5, "Auto"), ("c", 0, 0.5, 100.0, None), ("d", 0, None, 100.0, "Home"), ("e", 0, 0.9, None, "Home")]
    got = {(r["level"], r["risk_tier"], r["loan_purpose"]): r for r in portfolio.expected_loss(scored(spark, rows, ", loan_amount double, loan_purpose string")).collect()}
    total = got["total", None, None]
    assert (total["n"], total["n_missing"], float(total["exposure"]), float(total["expected_loss"])) == (5, 2, 3100.5, 63.01)
    assert float(got["tier", "Low Risk", None]["exposure"]) == 3000.5 and got["purpose", "Very High Risk", "(missing)"]["n"] == 1 and got["tier", "(missing)", None]["n"] == 1
    assert got["tier", "Medium Risk", None]["loss_rate"] is None and total["loss_rate"] == pytest.approx(63.01 / 3100.5, abs=1e-6)
    assert sum(float(r["expected_loss"]) for k, r in got.items() if k[0] == "purpose") == pytest.approx(float(total["expected_loss"]))


def test_blend_weights(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 2000)
    a, b = np.clip(0.3 * y + rng.random(2000) * 0.7, 0, 1), np.clip(0.2 * y + rng.random(2000) * 0.8, 0, 1)
    champion = scored(spark, [(f"c{k}", int(y[k]), float(a[k])) for k in range(2000)] + [("only", 1, 0.5), ("gap", 1, None)])
    challenger = scored(spark, [(f"c{k}", int(y[k]), float(b[k])) for k in range(2000)] + [("other", 1, 0.5), ("gap", 1, 0.5)])
    pairs = blend.paired_scores(champion, challenger)
    weights = blend.blend_weights(pairs)
    assert pairs.count() == 2000 and weights == pytest.approx(np.linalg.lstsq(np.stack([a, b], 1), y, rcond=None)[0], rel=1e-6)
    report = {r["model"]: r for r in blend.champion_challenger(champion, challenger).collect()}
    assert report["blend"]["roc_auc"] >= max(report["champion"]["roc_auc"], report["challenger"]["roc_auc"]) and report["blend"]["brier"] <= min(report["champion"]["brier"], report["challenger"]["brier"])
    assert blend.blend_weights(blend.paired_scores(champion, champion))[1] == 0.0 and blend.blend_weights(pairs.limit(0)) == (1.0, 0.0)


def test_vif_prune_against_numpy(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((800, 4))
    table = np.column_stack([base, base[:, 0] + 0.1 * rng.standard_normal(800), base[:, 0] + base[:, 1] + 0.3 * rng.standard_normal(800), base[:, 2] * 2, np.ones(800)])
    names = [f"c{k}" for k in range(8)]
    frame = spark.createDataFrame(pd.DataFrame(table, columns=names).assign(creditworthy=(base[:, 3] + base[:, 1] + rng.standard_normal(800) > 0).astype(int)))
    survivors, report = selection.vif_prune(frame, names, 5.0)
    left, order = [n for n in names if n not in ("c6",)], ["c6"]
    while True:
        own = [n for n in left if n != "c7"]
        inverse = np.linalg.inv(np.corrcoef(table[:, [names.index(n) for n in own]].T))
        vifs = {n: inverse[k, k] for k, n in enumerate(own)}
        worst = max(vifs, key=vifs.get)
        if vifs[worst] <= 5:
            break
        order.append(worst)
        left.remove(worst)
    rows = {r["feature"]: r for r in report.collect()}
    assert sorted(survivors) == sorted(left) and [r["feature"] for r in sorted((r for r in rows.values() if r["dropped"]), key=lambda r: r["dropped"])] == order
    assert all(rows[n]["vif"] == pytest.approx(v, rel=1e-6) for n, v in vifs.items()) and rows["c6"]["vif"] == math.inf and rows["c7"]["vif"] == 1.0
    fitted = {r["feature"]: r["weight"] for r in selection.pruned_scorecard(frame, names, 5.0).collect()}
    assert fitted["c6"] is None and fitted["c3"] > 0.8 and set(n for n, w in fitted.items() if w is not None) == set(left)


def feed_rows(hours, per_hour=40, shift=0.0):
    start = dt.datetime(2024, 1, 1)
    return [(start + dt.timedelta(hours=h, seconds=83 * k), min(1.0, (k * 37 % 101) / 100 + shift * h) if k % 13 else None) for h in hours for k in range(per_hour)]


def test_drift_stream_with_late_rows_and_a_restart(spark):
    reference = drift.drift_reference(spark.createDataFrame([(k / 100,) for k in range(101)], "p double"))
    feed, out, checkpoint = (scratch_path(spark, k) for k in ("feed", "out", "chk"))
    ddl = "ts timestamp, p double"

    def arrive(rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(ddl).parquet(feed)
        drift.score_drift_stream(stream, reference).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return {r["window_start"]: (r["n"], r["psi"]) for r in spark.read.schema(drift.DRIFT).parquet(out).collect()}

    first, half = feed_rows(range(0, 5), shift=0.05), feed_rows([5], shift=0.05)
    batch = {r["window_start"]: (r["n"], r["psi"]) for r in drift.score_drift(spark.createDataFrame(first + half + feed_rows(range(6, 9)), ddl), reference).collect()}
    got = arrive(first + half[:20] + [(None, 0.5)])
    assert got == {w: v for w, v in batch.items() if w.hour < 4}  # hour 4 ends at 5, and only hour 5 has begun
    late = [(dt.datetime(2024, 1, 1, 1, 5), 0.5)] * 30  # of a closed window: not counted
    assert arrive(half[20:] + late) == got
    got = arrive(feed_rows(range(6, 9)))  # hour 5 goes on from the state of two earlier runs
    assert got == {w: v for w, v in batch.items() if w.hour < 7} and got[dt.datetime(2024, 1, 1, 5)][0] == 40


def test_drift_batch_is_the_stability_index(spark):
    rows = feed_rows([0], 300, 0.0)
    reference = spark.createDataFrame([((k % 70) / 100,) for k in range(700)] + [(None,)] * 9, "p double")
    psi = drift.score_drift(spark.createDataFrame(rows, "ts timestamp, p double").filter("hour(ts) = 0"), drift.drift_reference(reference)).collect()[0]["psi"]
    actual = spark.createDataFrame(rows, "ts timestamp, p double").filter("hour(ts) = 0")
    assert psi == pytest.approx(stability.population_stability(reference, actual, ["p"]).first()["psi"], abs=2e-6)
