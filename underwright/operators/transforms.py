"""Transforms that are fitted on the training rows and applied unchanged elsewhere.

A fit is a few aggregations whose result is a small dict; applying it is one projection. The
estimator classes at the end wrap the same functions for use as Spark ML stages.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.quantiles import exact_quantiles
from underwright.functions.scalars import clip_null, flag, log1p0, name, number, text, unpivot, with_exprs
from underwright.operators.features import engineer_features
from underwright.sources.contract import EDUCATION_LEVELS, MONEY

WINSOR_BOUNDS = (0.01, 0.99)
MONTHS = "months_since_last_delinquency"
MONTHS_FILL = 120.0
MISSING_LABEL = "missing"
UTIL_RANGE = (0.0, 1.5)
MAX_CATEGORIES = 1000

# Input columns of each transform group, in output order.
COUNTS = ("age", "dependents", "employment_years", "num_open_accounts", "num_credit_inquiries_6m",
          "num_late_payments_12m", "num_previous_defaults", "loan_term_months")
RATIO = ("credit_utilization_ratio",)
SCORE_RATE = ("credit_score", "interest_rate")
FINANCIAL_RATIO = ("dti_ratio", "loan_monthly_burden", "savings_to_income", "credit_inquiry_density")
COMPOSITE = ("financial_health_index", "risk_index", "payment_consistency", "income_stability")
FLAGS = ("maxed_out_flag", "has_delinquency_history")
NOMINAL = ("employment_status", "loan_purpose", "credit_tier")
ORDINAL = ("education",)
MEDIAN_COLUMNS = (*MONEY, *COUNTS, *RATIO, *SCORE_RATE, *FINANCIAL_RATIO, *COMPOSITE)
ROBUST_COLUMNS = (*MONEY, *COUNTS, *FINANCIAL_RATIO)
STANDARD_COLUMNS = (*RATIO, *SCORE_RATE, *COMPOSITE, *FLAGS, MONTHS)
INDICATOR = f"missingindicator_{MONTHS}"


# --- fits -----------------------------------------------------------------------------------------


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    medians = exact_quantiles(df, list(columns), (0.5,))
    return {c: 0.0 if q[0] is None else q[0] for c, q in medians.items()}


def category_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """Rows per value of nominal columns. More than ``MAX_CATEGORIES`` values is an error, not a cut."""
    counts = unpivot(df, [], list(columns), "string").filter("value IS NOT NULL").groupBy(
        "column", "value").agg(F.expr("count(*) AS n"))
    rows = counts.limit(MAX_CATEGORIES * len(columns) + 1).collect()
    out: dict[str, dict[str, int]] = {c: {} for c in columns}
    for r in rows:
        out[r["column"]][r["value"]] = r["n"]
    wide = [c for c, values in out.items() if len(values) > MAX_CATEGORIES]
    if wide or len(rows) > MAX_CATEGORIES * len(columns):
        raise ValueError(f"too many categories for one-hot columns: {wide or columns}")
    return out


def mode_of(counts: Mapping[str, int]) -> str | None:
    """Most frequent value; the smallest wins a tie."""
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column, whatever their number; the smallest wins a tie, a column without values has None."""
    counts = unpivot(df, [], list(columns), "string").filter("value IS NOT NULL").groupBy("column", "value").agg(F.expr("count(*) AS n"))
    first = counts.groupBy("column").agg(F.expr("min(struct(-n AS k, value)) AS m")).select("column", "m.value").collect()
    return {c: None for c in columns} | {r["column"]: r["value"] for r in first}


def fit_categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Categories of the imputed columns, alphabetical."""
    filled = df.selectExpr(*[f"{impute_missing_label(c)} AS {name(c)}" for c in columns])
    return {c: sorted(values) for c, values in category_counts(filled, columns).items()}


def fit_winsor(df: DataFrame, exprs: Mapping[str, str]) -> dict[str, list[float]]:
    """Lower and upper clip bounds; ``exprs`` are the imputed columns."""
    return exact_quantiles(df, exprs, WINSOR_BOUNDS)


def fit_robust(df: DataFrame, exprs: Mapping[str, str]) -> dict[str, list[float]]:
    """(median, IQR); a zero IQR scales by 1."""
    q = exact_quantiles(df, exprs, (0.25, 0.5, 0.75))
    return {c: [v[1], (v[2] - v[0]) or 1.0] if v[1] is not None else [0.0, 1.0] for c, v in q.items()}


def fit_standard(df: DataFrame, exprs: Mapping[str, str]) -> dict[str, list[float]]:
    """(mean, population deviation); a zero deviation scales by 1."""
    names = list(exprs)
    row = df.selectExpr(*[f"avg({exprs[c]}) AS m{i}" for i, c in enumerate(names)],
                        *[f"stddev_pop({exprs[c]}) AS s{i}" for i, c in enumerate(names)]).first()
    return {c: [row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0] for i, c in enumerate(names)}


# --- projections ----------------------------------------------------------------------------------


def impute(c: str, value: float | str | None) -> str:
    if value is None:
        return name(c)
    return f"coalesce({name(c)}, {text(value) if isinstance(value, str) else number(value)})"


def impute_missing_label(c: str) -> str:
    return f"coalesce({name(c)}, {text(MISSING_LABEL)})"


def missing_indicator(c: str) -> str:
    return f"CAST({flag(f'{name(c)} IS NULL')} AS DOUBLE)"


def winsorize(c: str, bounds: Sequence[float | None]) -> str:
    return c if bounds[0] is None else clip_null(c, bounds[0], bounds[1])


def rescale(c: str, centre_scale: Sequence[float]) -> str:
    return f"({c} - {number(centre_scale[0])}) / {number(centre_scale[1])}"


def clip_util_transform(c: str) -> str:
    return clip_null(c, *UTIL_RANGE)


def onehot(c: str, categories: Sequence[str]) -> dict[str, str]:
    """One 0/1 column per training category; an unseen value is all zeros."""
    filled = impute_missing_label(c)
    return {f"{c}_{v}": f"CAST({flag(f'{filled} = {text(v)}')} AS DOUBLE)" for v in categories}


def ordinal_education(c: str) -> str:
    """High School 0 .. Doctorate 3, anything else -1."""
    steps = " ".join(f"WHEN {c} = {text(level)} THEN {number(i)}" for i, level in enumerate(EDUCATION_LEVELS))
    return f"CASE {steps} ELSE -1D END"


# --- the whole table ------------------------------------------------------------------------------


def _imputed(state: Mapping, c: str) -> str:
    if c in state["median"]:
        return impute(c, state["median"][c])
    if c in FLAGS:
        return impute(c, float(state["mode"][c] or 0))
    return impute(c, MONTHS_FILL)


def _unscaled(state: Mapping, c: str) -> str:
    """Column after imputation, clipping and logarithm, before scaling."""
    x = _imputed(state, c)
    if c in MONEY:
        return log1p0(winsorize(x, state["winsor"][c]))
    return clip_util_transform(x) if c in RATIO else x


def fit_preprocess(df: DataFrame) -> dict:
    """State of all groups from training rows that carry the engineered columns."""
    probe = with_exprs(df, {
        **{c: impute_missing_label(c) for c in NOMINAL}, "_months": f"{name(MONTHS)} IS NULL"})
    counts = category_counts(probe, [*FLAGS, *ORDINAL, *NOMINAL, "_months"])
    state: dict = {
        "median": fit_medians(df, MEDIAN_COLUMNS),
        "mode": {c: mode_of(counts[c]) for c in (*FLAGS, *ORDINAL)},
        "categories": {c: sorted(counts[c]) for c in NOMINAL},
        "indicator": "true" in counts["_months"],
    }
    state["winsor"] = fit_winsor(df, {c: _imputed(state, c) for c in MONEY})
    scale = fit_robust(df, {c: _unscaled(state, c) for c in ROBUST_COLUMNS})
    exprs = {c: _unscaled(state, c) for c in STANDARD_COLUMNS}
    if state["indicator"]:
        exprs[INDICATOR] = missing_indicator(MONTHS)
    state["scale"] = {**scale, **fit_standard(df, exprs)}
    return state


def output_columns(state: Mapping) -> dict[str, str]:
    """Name and expression of each transformed column, in group order."""
    out = {c: rescale(_unscaled(state, c), state["scale"][c]) for c in (*MEDIAN_COLUMNS, *FLAGS, MONTHS)}
    if state["indicator"]:
        out[INDICATOR] = rescale(missing_indicator(MONTHS), state["scale"][INDICATOR])
    for c in NOMINAL:
        out.update(onehot(c, state["categories"][c]))
    for c in ORDINAL:
        out[c] = ordinal_education(impute(c, state["mode"][c]))
    return out


def apply_preprocess(df: DataFrame, state: Mapping, keep: Sequence[str] = ()) -> DataFrame:
    """Transformed columns only (plus ``keep``); everything else is dropped."""
    return df.selectExpr(*keep, *[f"{e} AS {name(n)}" for n, e in output_columns(state).items()])


def class_weights(df: DataFrame, target: str) -> dict[str, float]:
    """Balanced weights n / (2 n_c), and the boosting weight n_neg / n_pos of the positive class."""
    row = df.selectExpr(f"count_if({target} = 0) AS n0", f"count_if({target} = 1) AS n1").first()
    n0, n1 = row["n0"], row["n1"]
    return {
        "w0": (n0 + n1) / (2 * n0) if n0 else 1.0,
        "w1": (n0 + n1) / (2 * n1) if n1 else 1.0,
        "pos": n0 / n1 if n1 and n0 else 1.0,
    }


def with_class_weight(df: DataFrame, target: str, weights: Mapping[str, float]) -> DataFrame:
    good = f"{target} = 1"
    return with_exprs(df, {
        "weight": f"IF({good}, {number(weights['w1'])}, {number(weights['w0'])})",
        "pos_weight": f"IF({good}, {number(weights['pos'])}, 1D)",
    })


# --- Spark ML stages ------------------------------------------------------------------------------


class FeatureEngineer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Appends the domain features."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return engineer_features(dataset)


class _Prefixed(Params):
    prefix = Param(Params._dummy(), "prefix", "put before each output column", TypeConverters.toString)

    def getPrefix(self) -> str:
        return self.getOrDefault(self.prefix)


class Preprocess(Estimator, _Prefixed, DefaultParamsReadable, DefaultParamsWritable):
    """Fits all transform groups on engineered training rows."""

    @keyword_only
    def __init__(self, *, prefix: str = "t_") -> None:
        super().__init__()
        self._setDefault(prefix="t_")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PreprocessModel:
        return PreprocessModel(state=json.dumps(fit_preprocess(dataset)), prefix=self.getPrefix())


class PreprocessModel(Model, _Prefixed, DefaultParamsReadable, DefaultParamsWritable):
    """Appends the transformed columns under a prefix; the fitted state is one JSON parameter."""

    state = Param(Params._dummy(), "state", "fitted state as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state: str = "{}", prefix: str = "t_") -> None:
        super().__init__()
        self._setDefault(state="{}", prefix="t_")
        self._set(**self._input_kwargs)

    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def names(self) -> list[str]:
        return list(output_columns(self.fitted()))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        prefix = self.getPrefix()
        return dataset.selectExpr("*", *[f"{e} AS {name(prefix + n)}" for n, e in output_columns(self.fitted()).items()])
