"""Queries on transforms fitted on the training rows and applied to every row."""

from __future__ import annotations

from catalog.registry import cleaned, features, register, round_doubles
from catalog.sql import MONEY, r, sql
from catalog.tables import SPLIT_SQL
from underwright.functions.scalars import log1p0, name, rounded, with_exprs
from underwright.operators import transforms as tr
from underwright.operators.splits import stratified_split
from underwright.session import materialise

_SPLIT = {"split": SPLIT_SQL.format(val=0.2),
          "rows_": "SELECT f.*, s.split FROM features f JOIN split s USING (customer_id)",
          "train": "SELECT * FROM rows_ WHERE split = 'train'"}


def split_rows(spark, sf):
    """Engineered rows with their split, written once because several passes read them."""
    return materialise(stratified_split(materialise(features(spark, sf), "features")), "split")


def train_of(rows):
    return rows.filter("split = 'train'")


def _fit(name_, fit, exprs, oracle, **ctes):
    """Register a fit on the training rows followed by a projection of all rows."""

    def query(spark, sf):
        rows = split_rows(spark, sf)
        out = exprs(fit(train_of(rows)))
        return rows.selectExpr("customer_id", *[f"{rounded(e) if numeric else e} AS {name(c)}" for c, (e, numeric) in out.items()])

    register(name_, sql("SELECT customer_id, " + oracle, "features", **_SPLIT, **ctes))(query)


def _num(exprs):
    return {c: (e, True) for c, e in exprs.items()}


_MED = ("age", "employment_years", "monthly_income", "savings_balance", "credit_score", "dti_ratio")
_fit("impute_median", lambda t: tr.fit_medians(t, _MED), lambda m: _num({c: tr.impute(c, m[c]) for c in _MED}),
     ", ".join(f"{r(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM train))')} AS {c}" for c in _MED) + " FROM rows_")

_MODE = ("education", "maxed_out_flag", "employment_status")


def _mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _impute_mode(spark, sf):
    rows = with_exprs(split_rows(spark, sf), {
        "education": "IF(age IS NULL, NULL, education)", "maxed_out_flag": "IF(credit_utilization_ratio IS NULL, NULL, maxed_out_flag)"})
    modes = tr.fit_modes(train_of(rows), _MODE)
    return rows.selectExpr("customer_id", tr.impute("education", modes["education"]) + " AS education",
                           f"CAST({tr.impute('maxed_out_flag', float(modes['maxed_out_flag']))} AS INT) AS maxed_out_flag",
                           tr.impute("employment_status", modes["employment_status"]) + " AS employment_status")


register("impute_mode", sql(
    "SELECT customer_id, " + ", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in _MODE) + " FROM holes", "features",
    split=_SPLIT["split"], rows_=_SPLIT["rows_"],
    holes="SELECT customer_id, split, CASE WHEN age IS NOT NULL THEN education END AS education, "
          "CASE WHEN credit_utilization_ratio IS NOT NULL THEN maxed_out_flag END AS maxed_out_flag, employment_status FROM rows_",
    train="SELECT * FROM holes WHERE split = 'train'"))(_impute_mode)

_FILLED = "coalesce(months_since_last_delinquency, 120e0)"
_HOLE = "CASE WHEN months_since_last_delinquency IS NULL THEN 1e0 ELSE 0e0 END"
register("impute_const_indicator", sql(
    f"SELECT customer_id, {_FILLED} AS months_since_last_delinquency, {_HOLE} AS missingindicator_months_since_last_delinquency "
    "FROM features", "features"))(
    lambda spark, sf: features(spark, sf).selectExpr(
        "customer_id", f"{tr.impute(tr.MONTHS, tr.MONTHS_FILL)} AS {tr.MONTHS}",
        f"{tr.missing_indicator(tr.MONTHS)} AS {tr.INDICATOR}"))
register("impute_missing_label", sql(
    "SELECT customer_id, coalesce(credit_tier, 'missing') AS credit_tier FROM features", "features"))(
    lambda spark, sf: features(spark, sf).selectExpr("customer_id", f"{tr.impute_missing_label('credit_tier')} AS credit_tier"))


def _filled(c: str, source: str = "train") -> str:
    return f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM train))"


_IMP = {"imp": "SELECT customer_id, split, " + ", ".join(f"{_filled(c)} AS {c}" for c in MONEY) + " FROM rows_",
        "imt": "SELECT * FROM imp WHERE split = 'train'"}


def _wins(c: str) -> str:
    return (f"greatest((SELECT quantile_cont({c}, 0.01) FROM imt), least({c}, (SELECT quantile_cont({c}, 0.99) FROM imt)))")


def _winsor_state(train):
    medians = tr.fit_medians(train, MONEY)
    return medians, tr.fit_winsor(train, {c: tr.impute(c, medians[c]) for c in MONEY})


_fit("winsorize", _winsor_state, lambda s: _num({c: tr.winsorize(tr.impute(c, s[0][c]), s[1][c]) for c in MONEY}),
     ", ".join(f"{r(_wins(c))} AS {c}" for c in MONEY) + " FROM imp", **_IMP)
register("log1p_transform", sql(
    "SELECT customer_id, " + ", ".join(f"{r(f'ln(1 + CASE WHEN {c} IS NOT NULL THEN greatest({c}, 0e0) END)')} AS {c}" for c in MONEY)
    + " FROM features", "features"))(
    lambda spark, sf: features(spark, sf).selectExpr("customer_id", *[f"{rounded(log1p0(c))} AS {c}" for c in MONEY]))

_TRAIN = "train"
_ROBUST = ("age", "num_open_accounts", "num_late_payments_12m", "num_previous_defaults")


def _iqr(c: str, source: str) -> str:
    return (f"(SELECT CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1e0 ELSE quantile_cont({c}, 0.75) - "
            f"quantile_cont({c}, 0.25) END FROM {source})")


_fit("scale_robust", lambda t: tr.fit_robust(t, {c: c for c in _ROBUST}), lambda s: _num({c: tr.rescale(c, s[c]) for c in _ROBUST}),
     ", ".join(f"{r(f'({c} - (SELECT quantile_cont({c}, 0.5) FROM train)) / {_iqr(c, _TRAIN)}')} AS {c}" for c in _ROBUST)
     + " FROM rows_")
_STANDARD = ("credit_score", "interest_rate", "risk_index", "income_stability")


def _std(c: str, source: str) -> str:
    return f"(SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1e0 ELSE stddev_pop({c}) END FROM {source})"


_fit("scale_standard", lambda t: tr.fit_standard(t, {c: c for c in _STANDARD}),
     lambda s: _num({c: tr.rescale(c, s[c]) for c in _STANDARD}),
     ", ".join(f"{r(f'({c} - (SELECT avg({c}) FROM train)) / ' + _std(c, 'train'))} AS {c}" for c in _STANDARD) + " FROM rows_")
register("clip_util_transform", sql(
    "SELECT row_seq, CASE WHEN credit_utilization_ratio IS NOT NULL THEN greatest(0e0, least(credit_utilization_ratio, 1.5e0)) END "
    "AS credit_utilization_ratio FROM cleaned", "cleaned"))(
    lambda spark, sf: cleaned(spark, sf).selectExpr(
        "row_seq", f"{tr.clip_util_transform('credit_utilization_ratio')} AS credit_utilization_ratio"))

# The categories that occur in the fixture.
_CATEGORIES = {
    "employment_status": ("Employed", "Self-Employed", "Unemployed"),
    "loan_purpose": ("Auto", "Business", "Debt Consolidation", "Education", "Home", "Medical", "Personal"),
    "credit_tier": ("Deep Subprime", "Near-Prime", "Prime", "Subprime", "missing"),
}
_HOT = {f"{c}_{v}": f"CASE WHEN coalesce({c}, 'missing') = '{v}' THEN 1e0 ELSE 0e0 END"
        for c, values in _CATEGORIES.items() for v in values}
_fit("onehot", lambda t: tr.fit_categories(t, tr.NOMINAL),
     lambda s: {k: (e, False) for c in tr.NOMINAL for k, e in tr.onehot(c, s[c]).items()},
     ", ".join(f'{e} AS "{c}"' for c, e in _HOT.items()) + " FROM rows_")
_ORD = "CASE {c} WHEN 'High School' THEN 0e0 WHEN 'Bachelor' THEN 1e0 WHEN 'Master' THEN 2e0 WHEN 'Doctorate' THEN 3e0 ELSE -1e0 END"
register("ordinal_education", sql(f"SELECT customer_id, {_ORD.replace('{c}', 'education')} AS education FROM features", "features"))(
    lambda spark, sf: features(spark, sf).selectExpr("customer_id", f"{tr.ordinal_education('education')} AS education"))

# --- the whole table ------------------------------------------------------------------------------


def _stage(columns: dict[str, str], source: str) -> str:
    return "SELECT customer_id, split, " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}"


_S1 = {c: _filled(c) for c in tr.MEDIAN_COLUMNS}
_S1.update({c: f"CAST(coalesce({c}, {_mode_sql(c)}) AS DOUBLE)" for c in tr.FLAGS})
_S1.update({tr.MONTHS: _FILLED, tr.INDICATOR: _HOLE, "education": f"coalesce(education, {_mode_sql('education')})",
            **{c: c for c in tr.NOMINAL}})
_S2 = {c: c for c in _S1}
_S2.update({c: f"ln(1 + greatest({_wins(c)}, 0e0))" for c in MONEY})
_S2["credit_utilization_ratio"] = "greatest(0e0, least(credit_utilization_ratio, 1.5e0))"
_S3 = {}
for _c in tr.ROBUST_COLUMNS:
    _S3[_c] = f"({_c} - (SELECT quantile_cont({_c}, 0.5) FROM s2t)) / {_iqr(_c, 's2t')}"
for _c in (*tr.STANDARD_COLUMNS, tr.INDICATOR):
    _S3[_c] = f"({_c} - (SELECT avg({_c}) FROM s2t)) / {_std(_c, 's2t')}"
_S3.update({f'"{c}"': e for c, e in _HOT.items()})
_S3["education"] = _ORD.replace("{c}", "education")
PREPROCESSED = {
    **_SPLIT,
    "imp": _stage(_S1, "rows_"), "imt": "SELECT * FROM imp WHERE split = 'train'",
    "s2": _stage(_S2, "imp"), "s2t": "SELECT * FROM s2 WHERE split = 'train'",
    "matrix": _stage(_S3, "s2"),
}
OUTPUT_NAMES = list(_S3)
_MATRIX = "SELECT customer_id, " + ", ".join(f"{r(c, 4)} AS {c}" for c in OUTPUT_NAMES) + " FROM matrix"


@register("preprocess", sql(_MATRIX, "features", **PREPROCESSED))
def _preprocess(spark, sf):
    rows = split_rows(spark, sf)
    return round_doubles(tr.apply_preprocess(rows, tr.fit_preprocess(train_of(rows)), ("customer_id",)), 4)


@register("full_transform", sql(
    "SELECT customer_id, split, " + ", ".join(f"{r(c, 4)} AS {c}" for c in OUTPUT_NAMES) + " FROM matrix", "features", **PREPROCESSED))
def _full_transform(spark, sf):
    from pyspark.ml import Pipeline

    rows = materialise(stratified_split(materialise(cleaned(spark, sf), "cleaned")), "rows")
    fitted = Pipeline(stages=[tr.FeatureEngineer(), tr.Preprocess()]).fit(train_of(rows))
    names = fitted.stages[-1].names()
    return round_doubles(fitted.transform(rows).selectExpr("customer_id", "split", *[f"{name('t_' + c)} AS {name(c)}" for c in names]), 4)


@register("class_weight", sql(
    f"SELECT creditworthy AS class, CAST(count(*) AS BIGINT) AS n, {r('(SELECT count(*) FROM train) / (2e0 * count(*))')} AS weight, "
    f"{r('CASE WHEN creditworthy = 1 THEN (SELECT count(*) * 1e0 FROM train WHERE creditworthy = 0) / count(*) ELSE 1e0 END')} AS pos_weight "
    "FROM train GROUP BY 1", "features", **_SPLIT))
def _class_weight(spark, sf):
    from pyspark.sql import functions as F

    train = train_of(split_rows(spark, sf))
    weighted = tr.with_class_weight(train, "creditworthy", tr.class_weights(train, "creditworthy"))
    return weighted.groupBy(F.expr("creditworthy AS class")).agg(
        F.expr("count(*) AS n"), F.expr(f"{rounded('max(weight)')} AS weight"), F.expr(f"{rounded('max(pos_weight)')} AS pos_weight"))
