"""Row-level cleaning that learns nothing from the data. Absent columns are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.ranking import keep_first
from underwright.functions.scalars import clip_null, long_rows, text, with_exprs
from underwright.sources.contract import APPLICANT_COLUMNS, ID, MONEY, PROTECTED, ROW_SEQ, TARGET

MIN_AGE = 18
# Column and its valid range.
CLIPS = {"credit_score": (300, 850), "credit_utilization_ratio": (0, 1.5), "interest_rate": (0, 40)}


def dedup_rows(df: DataFrame) -> DataFrame:
    """Drop exact copies (null-safe)."""
    return df.dropDuplicates()


def dedup_key(df: DataFrame, id_col: str = ID, order: str = ROW_SEQ) -> DataFrame:
    """Keep the first row of each id in ``order``."""
    return keep_first(df, [id_col], [order])


def _with(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return with_exprs(df, {c: e for c, e in exprs.items() if c in df.columns})


def null_underage(df: DataFrame) -> DataFrame:
    return _with(df, {"age": f"CASE WHEN age >= {MIN_AGE} THEN age END"})


def clip_column(df: DataFrame, *columns: str) -> DataFrame:
    return _with(df, {c: clip_null(c, *CLIPS[c]) for c in columns})


def null_bad_term(df: DataFrame) -> DataFrame:
    return _with(df, {"loan_term_months": "CASE WHEN loan_term_months > 0 THEN loan_term_months END"})


def null_negative_money(df: DataFrame) -> DataFrame:
    return _with(df, {c: f"CASE WHEN {c} >= 0 THEN {c} END" for c in MONEY})


def floor_dependents(df: DataFrame) -> DataFrame:
    return _with(df, {"dependents": "CASE WHEN dependents < 0 THEN 0D ELSE dependents END"})


def repair_values(df: DataFrame) -> DataFrame:
    """All value rules, without removing rows."""
    df = clip_column(null_underage(df), *CLIPS)
    return floor_dependents(null_negative_money(null_bad_term(df)))


def clean_applicants(df: DataFrame) -> DataFrame:
    """First row per id, then the value rules. Exact copies share their id, so one shuffle removes both."""
    if ID not in df.columns:
        return repair_values(dedup_rows(df))
    return repair_values(dedup_key(df) if ROW_SEQ in df.columns else keep_first(df, [ID], []))


def _rules(columns: list[str]) -> dict[str, str]:
    """Name and condition of each value rule whose column is present."""
    rules = {"age_under_18": ("age", f"age < {MIN_AGE}")}
    rules.update({f"{c}_clipped": (c, f"{c} < {lo} OR {c} > {hi}") for c, (lo, hi) in CLIPS.items()})
    rules["loan_term_months_not_positive"] = ("loan_term_months", "loan_term_months <= 0")
    rules.update({f"{c}_negative": (c, f"{c} < 0") for c in MONEY})
    rules["dependents_negative"] = ("dependents", "dependents < 0")
    return {rule: condition for rule, (column, condition) in rules.items() if column in columns}


def clean_change_log(df: DataFrame) -> DataFrame:
    """Rows before and after, rows removed and values touched per rule, as (rule, n)."""
    columns = df.columns
    distinct = df.groupBy(*columns).agg(F.expr("count(*) AS _copies"))
    rest = [c for c in columns if c != ID and c != ROW_SEQ]
    per_id = distinct.groupBy(ID).agg(
        F.expr(f"min(struct({', '.join([ROW_SEQ, *rest])})) AS _f"),
        F.expr("sum(_copies) AS _copies"), F.expr("count(*) AS _variants"))
    totals = {
        "rows_before": "sum(_copies)",
        "duplicate_rows": "sum(_copies - _variants)",
        "duplicate_ids": "sum(_variants - 1)",
        **{rule: f"count_if({condition})" for rule, condition in _rules(columns).items()},
        "rows_after": "count(*)",
    }
    row = per_id.select(ID, "_f.*", "_copies", "_variants").selectExpr(
        *[f"coalesce({e}, 0L) AS {c}" for c, e in totals.items()])
    return long_rows(row, [{"rule": text(c), "n": c} for c in totals])


def prepare_features(df: DataFrame, target: str = TARGET, drop: tuple[str, ...] = (ID, ROW_SEQ, *PROTECTED)) -> DataFrame:
    """Model inputs plus the target as ``label``."""
    return df.drop(*drop).withColumnRenamed(target, "label")


def select_features(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Keep the named columns; the second result lists the names that were not found."""
    missing = [n for n in names if n not in df.columns]
    return df.select(*keep, *[n for n in names if n in df.columns]), missing


def enforce_types(df: DataFrame) -> DataFrame:
    """Cast known columns to the declared types; a value that does not parse becomes NULL."""
    types = {n: t for n, t in APPLICANT_COLUMNS if n in df.columns}
    return with_exprs(df, {n: f"try_cast({n} AS {t})" for n, t in types.items()})
