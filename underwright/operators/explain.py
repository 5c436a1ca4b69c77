"""Global importances and local explanations of a score."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwright.functions.quantiles import exact_quantiles
from underwright.functions.ranking import hash_ranked, window
from underwright.functions.scalars import hash_fraction, hash_order, name, number, odds_effect, odds_ratio, text
from underwright.operators.metrics import rank_metrics
from underwright.session import spread
from underwright.sources.contract import ID

REPEATS = 10
GRID_POINTS = 30
LIME_TERMS = 8


def pick_scenarios(scores: DataFrame, threshold: float, id_col: str = ID) -> DataFrame:
    """First approved good and first rejected bad applicant by id."""
    t = number(threshold)
    scenario = (f"CASE WHEN p >= {t} AND y = 1 THEN 'approved_good' WHEN p < {t} AND y = 0 THEN 'rejected_bad' END AS scenario")
    rows = scores.selectExpr(scenario, id_col, "y", "p").filter("scenario IS NOT NULL")
    first = rows.selectExpr("*", f"row_number() {window(['scenario'], [id_col])} AS _r")
    return first.filter("_r = 1").drop("_r")


def coefficient_codes(spark: SparkSession, coefficients: Mapping[str, float]) -> DataFrame:
    """Coefficient, odds ratio and effect per feature, strongest push to approval first."""
    table = spark.createDataFrame([(n, float(c)) for n, c in coefficients.items()], "feature string, coefficient double")
    return table.selectExpr("feature", "coefficient", f"{odds_ratio('coefficient')} AS odds_ratio",
                            f"{odds_effect('coefficient')} AS effect").orderBy(F.desc("coefficient"), "feature")


def top_drivers(codes: DataFrame, k: int = 8) -> DataFrame:
    """k largest and k smallest coefficients as (side, rank, feature, coefficient)."""
    parts = [
        codes.orderBy(F.desc("coefficient") if side == "top" else F.asc("coefficient"), "feature").limit(k).selectExpr(
            f"'{side}' AS side", f"row_number() {window([], ['coefficient' + order, 'feature'])} AS rank", "feature", "coefficient")
        for side, order in (("top", " DESC"), ("bottom", ""))
    ]
    return parts[0].unionByName(parts[1])


def linear_contributions(coefficients: Mapping[str, float], means: Mapping[str, float] | None = None) -> dict[str, str]:
    """Coefficient times value, centred on the mean where means are given (closed-form SHAP)."""
    return {
        n: f"{number(c)} * {name(n)}" if means is None else f"{number(c)} * ({name(n)} - {number(means[n])})"
        for n, c in coefficients.items()
    }


def linear_shap(df: DataFrame, coefficients: Mapping[str, float], id_col: str = ID) -> DataFrame:
    """Centred contribution of every feature and row, in long form (id, feature, contribution)."""
    means = df.selectExpr(*[f"avg({name(n)}) AS {name(n)}" for n in coefficients]).first().asDict()
    terms = linear_contributions(coefficients, means)
    pairs = ", ".join(f"named_struct('feature', {text(n)}, 'contribution', {e})" for n, e in terms.items())
    return df.selectExpr(id_col, f"inline(array({pairs}))")


# --- permutation importance -----------------------------------------------------------------------


def with_element(x: str, place: str, value: str) -> str:
    """Array ``x`` with ``value`` at the 0-based ``place``."""
    return f"concat(slice({x}, 1, {place}), array({value}), slice({x}, {place} + 2, size({x})))"


def permutation_importance(df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame],
                           repeats: int = REPEATS, seed: int = 42, id_col: str = ID, label: str = "y",
                           packed: str | None = None, per_core: int = 4) -> DataFrame:
    """Mean AUC drop per feature when its values are shuffled between rows.

    Every repeat has its own seeded order of the rows. A row takes the shuffled value from the row that
    holds its own position in that order, so one equi-join per repeat serves all features, and all
    features and repeats are scored in one job. ``score`` appends ``p`` to rows that have the feature
    columns. With many features, ``packed`` names an array column that holds them in this order; ``score`` then gets
    that column instead, and a row costs one array rather than a comparison per feature. ``per_core`` is the number of scoring tasks a core.
    """
    inputs = [packed] if packed else list(features)
    columns = name(packed) if packed else f"struct({', '.join(map(name, features))})"
    base = hash_ranked(df.selectExpr(id_col, f"{label} AS y", *map(name, inputs)), id_col, seed, rank="_pos")
    donors = df.selectExpr(id_col, f"{columns} AS _d", f"explode(sequence(1, {repeats})) AS repeat")
    donors = hash_ranked(donors, id_col, f"{seed}|donor", ["repeat"], "_pos", f"concat_ws('|', {id_col}, repeat)")
    rows = spread(base.selectExpr("*", f"explode(sequence(1, {repeats})) AS repeat"), "repeat", "_pos", per_core=per_core).join(
        spread(donors.select("repeat", "_pos", "_d"), "repeat", "_pos", per_core=per_core), ["repeat", "_pos"])
    targets = f"posexplode(array({', '.join(map(text, features))})) AS (_k, feature)"
    switched = [f"{with_element(name(packed), '_k', '_d[_k]')} AS {name(packed)}"] if packed else [
        f"IF(feature = {text(f)}, _d.{name(f)}, {name(f)}) AS {name(f)}" for f in features]
    shuffled = rows.selectExpr("repeat", "y", *map(name, inputs), "_d", targets).selectExpr("repeat", "feature", "y", *switched)
    drops = rank_metrics(score(shuffled).select("repeat", "feature", "y", "p"), ["feature", "repeat"])
    whole = rank_metrics(score(df.selectExpr(f"{label} AS y", *map(name, inputs))).select("y", "p")).first()["roc_auc"]
    return drops.groupBy("feature").agg(
        F.expr(f"round(avg({number(whole)} - roc_auc), 6) AS importance"),
        F.expr("round(stddev_pop(roc_auc), 6) AS deviation")).orderBy(F.desc("importance"), "feature")


# --- partial dependence ---------------------------------------------------------------------------


def feature_grid(df: DataFrame, feature: str, points: int = GRID_POINTS) -> list[float]:
    """All values of a feature with fewer than ``points``, else an even grid between its 5% and 95% quantiles."""
    present = df.select(feature).filter(f"{name(feature)} IS NOT NULL")
    # the exact values are only fetched when an estimate says that they are few
    if present.selectExpr(f"approx_count_distinct({name(feature)}) AS n").first()["n"] <= 2 * points:
        few = present.distinct().limit(points + 1).collect()
        if len(few) < points:
            return sorted(r[0] for r in few)
    low, high = exact_quantiles(df, [feature], (0.05, 0.95))[feature]
    return [low + (high - low) * i / (points - 1) for i in range(points)]


def partial_dependence(df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame],
                       points: int = GRID_POINTS) -> DataFrame:
    """Average score with one feature set to each grid value, as (feature, x, mean_p).

    A row meets the grid (at most ``points`` values per feature) inside its own task, and only the
    partial averages leave it.
    """
    grids = {f: feature_grid(df, f, points) for f in features}
    entries = ", ".join(f"struct({text(f)} AS f, {number(x)} AS v)" for f, grid in grids.items() for x in grid)
    others = [c for c in df.columns if c not in features]
    crossed = spread(df).selectExpr("*", f"explode(array({entries})) AS _g").selectExpr(
        *map(name, others), "_g", *[f"IF(_g.f = {text(f)}, _g.v, {name(f)}) AS {name(f)}" for f in features])
    means = score(crossed).groupBy("_g").agg(F.expr("avg(p) AS mean_p"))
    return means.selectExpr("_g.f AS feature", "_g.v AS x", "mean_p")


# --- model-agnostic local explanations ------------------------------------------------------------


def model_margin(model, names: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Scoring step for rows with an array column ``x``: appends ``margin`` and ``p``."""

    def score(rows: DataFrame) -> DataFrame:
        scored = model.transform(rows.withColumn("features", array_to_vector("x")))
        return scored.withColumns({
            "margin": F.element_at(vector_to_array("rawPrediction"), 2),
            "p": F.element_at(vector_to_array("probability"), 2),
        })

    return score


def shap_values(sample: DataFrame, background: DataFrame, names: Sequence[str], score: Callable[[DataFrame], DataFrame],
                permutations: int = 4, seed: int = 42, id_col: str = ID) -> DataFrame:
    """Sampled Shapley values of the margin as (id, feature, contribution).

    ``sample`` and ``background`` have (id, x). For each row and permutation a background row is drawn
    by hash; walking through the permuted features, each step switches one more feature from the
    background to the row, and the change of the margin is that feature's contribution. Per row the
    contributions add up to the margin minus the mean margin of its background rows.
    """
    size = len(names)
    ranked = hash_ranked(background.selectExpr(id_col, "x AS bx"), id_col, f"{seed}|background", rank="_pos")
    total = background.count()
    drawn = sample.selectExpr(id_col, "x", f"explode(sequence(1, {permutations})) AS perm").selectExpr(
        "*", f"CAST(floor({hash_fraction(id_col, 'perm', text(str(seed)))} * {total}) AS BIGINT) + 1 AS _pos")
    paired = drawn.join(ranked.select("_pos", "bx"), "_pos")
    order = (f"transform(array_sort(transform(sequence(0, {size - 1}), i -> struct(md5(concat_ws('|', {id_col}, perm, i, "
             f"{text(str(seed))})) AS h, i AS i))), s -> s.i) AS ord")
    steps = paired.selectExpr(id_col, "perm", "x", "bx", order).selectExpr(
        "*", f"explode(sequence(0, {size})) AS step")
    mixed = steps.selectExpr(
        id_col, "perm", "step", "IF(step = 0, -1, ord[greatest(step - 1, 0)]) AS switched",
        f"transform(sequence(0, {size - 1}), i -> IF(array_position(ord, i) <= step, x[i], bx[i])) AS x")
    margins = score(mixed).select(id_col, "perm", "step", "switched", "margin")
    change = margins.selectExpr(
        "*", f"margin - lag(margin) {window([id_col, 'perm'], ['step'])} AS delta").filter("step > 0")
    labels = f"array({', '.join(map(text, names))})[switched] AS feature"
    return change.selectExpr(id_col, labels, "delta").groupBy(id_col, "feature").agg(F.expr("avg(delta) AS contribution"))


def shap_importance(values: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return values.groupBy("feature").agg(F.expr("avg(abs(contribution)) AS importance")).orderBy(
        F.desc("importance"), "feature")


def shap_sample(df: DataFrame, rows: int | None = None, seed: int = 42, id_col: str = ID) -> DataFrame:
    """Reproducible sample of at most ``rows`` rows; all rows where no number is given."""
    return df if rows is None else df.orderBy(F.expr(hash_order(id_col, seed)), id_col).limit(rows)


def lime_local(explained: DataFrame, reference: DataFrame, names: Sequence[str], score: Callable[[DataFrame], DataFrame],
               perturbations: int = 2000, terms: int = LIME_TERMS, seed: int = 42, id_col: str = ID) -> DataFrame:
    """Weighted linear surrogate around each explained row, as (id, rank, feature, weight).

    ``explained`` (a few rows) has (id, x), ``reference`` the training columns. A perturbation draws each
    feature from its training distribution by a hashed uniform; the surrogate is a ridge regression on
    "same quartile as the explained row", weighted by closeness. Its group is one explained row with
    ``perturbations`` rows.
    """
    levels = [i / 20 for i in range(21)]
    tables = exact_quantiles(reference, list(names), levels)
    size = len(names)
    arrays = ", ".join(f"array({', '.join(number(v) for v in tables[n])})" for n in names)
    draws = explained.selectExpr(id_col, "x AS origin", f"array({arrays}) AS tables", f"explode(sequence(0, {perturbations - 1})) AS k")
    u = hash_fraction(id_col, "k", "i", text(str(seed)))
    value = ("tables[i][CAST(floor(u * 20) AS INT)] + (tables[i][CAST(floor(u * 20) AS INT) + 1] - tables[i][CAST(floor(u * 20) AS INT)])"
             " * (u * 20 - floor(u * 20))")
    # the first perturbation is the row itself
    drawn = draws.selectExpr(
        id_col, "origin", "k", "tables", f"transform(sequence(0, {size - 1}), i -> {u}) AS us").selectExpr(
        id_col, "origin", "k", "tables",
        f"IF(k = 0, origin, transform(sequence(0, {size - 1}), i -> {value.replace('u * 20', 'us[i] * 20')})) AS x")
    quartile = "size(filter(array(tables[i][5], tables[i][10], tables[i][15]), e -> e < {}))"
    same = f"transform(sequence(0, {size - 1}), i -> IF({quartile.format('x[i]')} = {quartile.format('origin[i]')}, 1D, 0D)) AS z"
    scored = score(drawn.selectExpr(id_col, "k", "x", same)).select(id_col, "z", "p")
    labels = list(names)

    def surrogate(group: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(group["z"].to_numpy())
        distance2 = size - z.sum(axis=1)
        w = np.sqrt(np.exp(-distance2 / (0.75**2 * size)))
        centre_z, centre_p = np.average(z, axis=0, weights=w), np.average(group["p"], weights=w)
        zc, pc = z - centre_z, group["p"].to_numpy() - centre_p
        beta = np.linalg.solve(zc.T @ (zc * w[:, None]) + np.eye(size), zc.T @ (pc * w))
        order = sorted(range(size), key=lambda i: (-abs(beta[i]), labels[i]))[:terms]
        return pd.DataFrame({id_col: group[id_col].iloc[0], "rank": range(1, len(order) + 1),
                             "feature": [labels[i] for i in order], "weight": beta[order]})

    kind = dict(explained.dtypes)[id_col]
    return scored.groupBy(id_col).applyInPandas(surrogate, f"{id_col} {kind}, rank int, feature string, weight double")
