"""Queries on importances and explanations. The fixed scorecard gives results that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.models import matrices
from catalog.registry import raw, register, round_doubles
from catalog.rows import _CARD_SQL, _TERM_SQL
from catalog.sql import r, sql
from underwright.functions.scalars import number, with_exprs
from underwright.operators import explain, models
from underwright.session import materialise
from underwright.sources import scorecard as card

_COEF = {t: w for t, w, _ in card.TERMS}
_P = "round(1e0 / (1e0 + exp(-(0.5e0 + " + " + ".join(f"({e})" for e in _TERM_SQL.values()) + "))), 6)"


def card_rows(spark, sf):
    """Scorecard inputs as (id, y, terms...), written once."""
    return materialise(card.scorecard_inputs(raw(spark, sf)).selectExpr("customer_id", "creditworthy AS y", *card.TERM_NAMES), "card")


def card_score(df):
    return with_exprs(df, {"p": card.probability()})


_CODES = " UNION ALL ".join(f"SELECT '{t}' AS feature, {w}e0 * stddev_pop({t}) AS coefficient FROM card" for t, w in _COEF.items())
_CODE_ROWS = ("SELECT feature, round(coefficient, 6) AS coefficient, round(exp(round(coefficient, 6)), 3) AS odds_ratio, CASE WHEN coefficient > 0 "
              "THEN 'increases approval odds' ELSE 'decreases approval odds' END AS effect FROM cd")


def _codes(spark, sf):
    """Coefficients per standard deviation of their term."""
    row = card_rows(spark, sf).selectExpr(*[f"stddev_pop({t}) AS {t}" for t in card.TERM_NAMES]).first()
    return explain.coefficient_codes(spark, {t: round(w * row[t], 6) for t, w in _COEF.items()})


register("coefficient_codes", sql(_CODE_ROWS, "dedup", card=_CARD_SQL, cd=_CODES))(_codes)
register("top_drivers", sql(
    "SELECT * FROM (SELECT 'top' AS side, CAST(row_number() OVER (ORDER BY coefficient DESC, feature) AS INTEGER) AS rank, feature, "
    "round(coefficient, 6) AS coefficient FROM cd UNION ALL SELECT 'bottom', CAST(row_number() OVER (ORDER BY coefficient, feature) AS INTEGER), "
    "feature, round(coefficient, 6) FROM cd) WHERE rank <= 2", "dedup", card=_CARD_SQL, cd=_CODES))(
    lambda spark, sf: explain.top_drivers(_codes(spark, sf), 2))
register("linear_shap", sql(" UNION ALL ".join(
    f"SELECT customer_id, '{t}' AS feature, {r(f'{w}e0 * ({t} - (SELECT avg({t}) FROM card))')} AS contribution FROM card"
    for t, w in _COEF.items()), "dedup", card=_CARD_SQL))(
    lambda spark, sf: round_doubles(explain.linear_shap(card_rows(spark, sf), _COEF)))

_REPEATS = 10
_SHUFFLED = " UNION ALL ".join(
    "SELECT repeat, '{f}' AS feature, y, {p} AS p FROM (SELECT b.repeat, b.y, {cols} FROM base b JOIN donor d ON d.repeat = b.repeat AND "
    "d.pos = b.pos)".format(f=f, p=_P, cols=", ".join(f"d.{t}" if t == f else f"b.{t}" for t in _COEF)) for f in _COEF)


def _auc(source: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return (f"SELECT {key}round(sum(n1 * (c0 - n0 / 2)) / max(t1 * t0), 6) AS auc FROM (SELECT *, sum(n0) OVER ({part} ORDER BY p) AS c0, "
            f"sum(n1) OVER ({part}) AS t1, sum(n0) OVER ({part}) AS t0 FROM (SELECT {key}p, CAST(sum(y) AS DOUBLE) AS n1, "
            f"CAST(sum(1 - y) AS DOUBLE) AS n0 FROM {source} GROUP BY ALL)) {group}")


register("permutation_importance", sql(
    "SELECT feature, round(avg((SELECT auc FROM whole) - auc), 6) AS importance, round(stddev_pop(auc), 6) AS deviation FROM aucs GROUP BY 1",
    "dedup", card=_CARD_SQL, reps=f"SELECT CAST(unnest(range(1, {_REPEATS + 1})) AS INTEGER) AS repeat",
    base="SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY md5(concat(customer_id, '|42')), customer_id) AS pos, creditworthy AS y FROM card, reps",
    donor="SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY md5(concat(customer_id, '|', repeat, '|42|donor')), customer_id) AS pos "
          "FROM card, reps",
    sh=_SHUFFLED, aucs=_auc("sh", "feature, repeat"), plain=f"SELECT creditworthy AS y, {_P} AS p FROM card", whole=_auc("plain", "")))(
    lambda spark, sf: explain.permutation_importance(card_rows(spark, sf), card.TERM_NAMES, card_score, _REPEATS))

_PDP = ("score", "util", "pc", "dti")
_GRID = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, lo + (hi - lo) * k / 29e0 AS x FROM (SELECT quantile_cont({f}, 0.05) AS lo, quantile_cont({f}, 0.95) AS hi, "
    f"count(DISTINCT {f}) AS d FROM card), (SELECT unnest(range(0, 30)) AS k) WHERE d >= 30 UNION ALL SELECT DISTINCT '{f}', {f} FROM card "
    f"WHERE (SELECT count(DISTINCT {f}) FROM card) < 30" for f in _PDP)
_PDP_SQL = " UNION ALL ".join(
    "SELECT feature, {x} AS x, {m} AS mean_p FROM (SELECT g.feature, g.x, {p} AS p FROM (SELECT g.feature, g.x, {cols} FROM card c, grid g WHERE "
    "g.feature = '{f}') g) GROUP BY feature, x".format(
        x=r("x"), m=r("avg(p)", 5), p=_P, f=f, cols=", ".join(f"g.x AS {t}" if t == f else f"c.{t}" for t in _COEF)) for f in _PDP)


def _pdp(spark, sf):
    out = explain.partial_dependence(card_rows(spark, sf), _PDP, card_score)
    return out.selectExpr("feature", "round(x, 6) + 0D AS x", "round(mean_p, 5) + 0D AS mean_p")


register("partial_dependence", sql(_PDP_SQL, "dedup", card=_CARD_SQL, grid=_GRID))(_pdp)


def _fitted(spark, sf):
    matrix, train, validation = matrices(spark, sf)
    return matrix, train, validation, models.logistic(train.count()).fit(train)


def _arrays(df):
    return df.select("customer_id", explain.vector_to_array("features").alias("x"))


@register("pdp_cross")
def _pdp_cross(spark, sf):
    """Partial dependence of a fitted model over the four transformed columns with the largest permutation importance."""
    matrix, _, validation, model = _fitted(spark, sf)
    columns = [f"f{i}" for i in range(len(matrix.names))]
    rows = materialise(validation.select("customer_id", "label", explain.vector_to_array("features").alias("x")), "rows")
    margin = explain.model_margin(model, columns)
    ranked = explain.permutation_importance(rows, columns, margin, label="label", packed="x").orderBy(F.desc("importance"), "feature")
    places = {row["feature"]: columns.index(row["feature"]) for row in ranked.limit(4).collect()}

    def score(df):
        x = "x"
        for column, place in places.items():
            x = explain.with_element(x, str(place), column)
        return margin(with_exprs(df, {"x": x}))

    flat = rows.selectExpr("customer_id", "x", *[f"x[{place}] AS {column}" for column, place in places.items()])
    return round_doubles(explain.partial_dependence(flat, list(places), score))


@register("shap_importance")
def _shap_importance(spark, sf):
    matrix, train, validation, model = _fitted(spark, sf)
    sample = explain.shap_sample(_arrays(validation))
    values = explain.shap_values(sample, _arrays(train), matrix.names, explain.model_margin(model, matrix.names))
    return round_doubles(explain.shap_importance(values))


@register("lime_local")
def _lime_local(spark, sf):
    matrix, train, validation, model = _fitted(spark, sf)
    picked = explain.pick_scenarios(models.positive_scores(model.transform(validation)), 0.64).select("customer_id")
    rows = _arrays(validation).join(picked, "customer_id")
    flat = _arrays(train).selectExpr(*[f"x[{i}] AS `{n}`" for i, n in enumerate(matrix.names)])
    return round_doubles(explain.lime_local(rows, flat, matrix.names, explain.model_margin(model, matrix.names)))


@register("model_reason_codes")
def _model_reason_codes(spark, sf):
    """Reason codes of a fitted logistic regression, from its coefficients and the transformed values."""
    from underwright.operators.scoring import reason_codes, reasons_long

    matrix, train, validation, model = _fitted(spark, sf)
    terms = {n: f"{number(c)} * x[{i}]" for i, (n, c) in enumerate(zip(matrix.names, model.coefficients.toArray()))}
    return round_doubles(reasons_long(with_exprs(_arrays(validation), {"reasons": reason_codes(terms, 4)})))
