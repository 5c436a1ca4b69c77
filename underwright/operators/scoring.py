"""Validation against the input contract, decisions, tiers and reason codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from underwright.functions.ranking import window
from underwright.functions.scalars import name, number, risk_tier, text, unpivot, with_exprs
from underwright.sources.contract import CONTRACT, ID, MODEL_INPUTS

DEFAULT_THRESHOLD = 0.64
SAMPLES_PER_RULE = 3
SCORE_COLUMNS = ("p_creditworthy", "p_default", "decision", "risk_tier")
NUMERIC_RULES = {r.feature: r for r in CONTRACT if r.kind == "numeric"}


class MissingColumnsError(ValueError):
    """A required input column is absent."""


class InvalidInputError(ValueError):
    """Input values break the contract."""


def schema_table(spark: SparkSession) -> DataFrame:
    """The contract, one row per model input."""
    rows = [(i + 1, r.feature, r.kind, r.nullable, None if r.minimum is None else float(r.minimum),
             None if r.maximum is None else float(r.maximum), list(r.allowed) or None)
            for i, r in enumerate(CONTRACT)]
    return spark.createDataFrame(
        rows, "position int, feature string, kind string, nullable boolean, minimum double, maximum double, allowed array<string>")


def check_columns(df: DataFrame) -> None:
    missing = [c for c in MODEL_INPUTS if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing required columns: {missing}")


def project_contract(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Required columns in contract order, numbers coerced; extra columns are ignored."""
    check_columns(df)
    typed = [f"try_cast({r.feature} AS DOUBLE) AS {r.feature}" if r.kind == "numeric" else r.feature for r in CONTRACT]
    return df.selectExpr(*keep, *typed)


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _conditions(df: DataFrame) -> list[tuple[str, str, str]]:
    """(feature, rule, condition) of every numeric rule; a missing value breaks none."""
    out = []
    for column, rule in NUMERIC_RULES.items():
        value = column
        if _is_text(df, column):
            value = f"try_cast({column} AS DOUBLE)"
            out.append((column, "not_numeric", f"{column} IS NOT NULL AND {value} IS NULL"))
        if rule.minimum is not None:
            out.append((column, "below_minimum", f"{value} < {number(rule.minimum)}"))
        if rule.maximum is not None:
            out.append((column, "above_maximum", f"{value} > {number(rule.maximum)}"))
    return out


def _bound(which: str) -> str:
    """Contract bound of the ``feature`` column, from a constant map of at most 18 entries."""
    known = {c: getattr(r, which) for c, r in NUMERIC_RULES.items() if getattr(r, which) is not None}
    return f"map({', '.join(f'{text(c)}, {number(v)}' for c, v in known.items())})[feature]"


def contract_violations(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Broken numeric rules in long form (id, feature, rule, value); missing values are skipped."""
    check_columns(df)
    texts = [c for c in NUMERIC_RULES if _is_text(df, c)]
    numbers = [c for c in NUMERIC_RULES if c not in texts]
    parts = []
    for kind, columns in (("double", numbers), ("string", texts)):
        if not columns:
            continue
        value = "try_cast(value AS DOUBLE)" if kind == "string" else "value"
        rule = (f"CASE WHEN {value} IS NULL THEN 'not_numeric' WHEN {value} < {_bound('minimum')} THEN 'below_minimum' "
                f"WHEN {value} > {_bound('maximum')} THEN 'above_maximum' END AS rule")
        long = unpivot(df, [id_col], columns, kind, "feature").filter("value IS NOT NULL")
        parts.append(long.selectExpr(id_col, "feature", rule, "CAST(value AS STRING) AS value").filter("rule IS NOT NULL"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def coerce_numeric(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Values that are present but not numbers."""
    return contract_violations(df, id_col).filter("rule = 'not_numeric'")


def range_check(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Numbers outside the contract range."""
    return contract_violations(df, id_col).filter("rule != 'not_numeric'")


def unknown_category(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Categories outside the contract: a warning, the row is still scored."""
    allowed = {r.feature: r.allowed for r in CONTRACT if r.kind == "categorical"}
    lists = ", ".join(f"{text(c)}, array({', '.join(map(text, values))})" for c, values in allowed.items())
    long = unpivot(df, [id_col], list(allowed), "string", "feature").filter("value IS NOT NULL")
    return long.filter(f"NOT array_contains(map({lists})[feature], value)")


def validation_summary(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Failed rules of a table with row counts and a message that shows the first values."""
    return summarise_violations(contract_violations(df, id_col), id_col)


def summarise_violations(bad: DataFrame, id_col: str = ID) -> DataFrame:
    """Rows per rule and a message with the samples of the first ids.

    ``row_number() <= k`` is a group limit that Spark applies in each task before the shuffle, so a
    rule broken by most rows moves only a few of them.
    """
    keys = ["feature", "rule"]
    samples = (
        bad.selectExpr("*", f"row_number() {window(keys, [id_col, 'value'])} AS _r")
        .filter(f"_r <= {SAMPLES_PER_RULE}")
        .groupBy(*keys)
        .agg(F.expr("sort_array(collect_list(struct(_r, value))) AS _s"))
    )
    counts = bad.groupBy(*keys).agg(F.expr("count(*) AS n"))
    message = "concat(\"'\", feature, \"' \", rule, ': ', array_join(transform(_s, s -> s.value), ', ')) AS message"
    return counts.join(samples, keys).selectExpr(*keys, "n", message)


def validate(df: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid rows with numbers as doubles, rejected rows with their violations); ``strict`` raises if any row is rejected."""
    check_columns(df)
    conditions = _conditions(df)
    broken = " OR ".join(f"coalesce({condition}, false)" for _, _, condition in conditions)
    notes = ", ".join(f"IF({condition}, concat_ws(' ', '{column}', '{rule}', CAST({column} AS STRING)), NULL)"
                      for column, rule, condition in conditions)
    rejected = df.filter(broken).selectExpr("*", f"array_compact(array({notes})) AS violations")
    if strict:
        keyed = df if ID in df.columns else df.withColumn(ID, F.monotonically_increasing_id())
        failed = validation_summary(keyed).orderBy("feature", "rule").collect()
        if failed:
            raise InvalidInputError("input validation failed: " + " | ".join(r["message"] for r in failed))
    typed = [f"try_cast({c} AS DOUBLE) AS {c}" if c in NUMERIC_RULES and _is_text(df, c) else f"`{c}`" for c in df.columns]
    return df.filter(f"NOT ({broken})").selectExpr(*typed), rejected


def score_exprs(p: str, threshold: float) -> list[str]:
    """Probabilities to 4 digits; decision and tier from the unrounded value."""
    return [
        f"round({p}, 4) AS p_creditworthy",
        f"round(1 - {p}, 4) AS p_default",
        f"CASE WHEN {p} >= {number(threshold)} THEN 'Approve' ELSE 'Reject' END AS decision",
        f"{risk_tier(f'(1 - {p})')} AS risk_tier",
    ]


def score_applicants(df: DataFrame, p: str, threshold: float = DEFAULT_THRESHOLD,
                     keep: tuple[str, ...] = (ID,)) -> DataFrame:
    """Decision table on the same frame; nothing is joined back."""
    return with_exprs(df, {"_p": p}).selectExpr(*keep, *score_exprs("_p", threshold))


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.expr("count(*) AS n"))


def reason_codes(contributions: Mapping[str, str], top_k: int = 5) -> str:
    """Top contributions of a row as array<struct<feature, contribution, direction>>, largest first.

    The terms of a row are sorted inside the row, so no shuffle is needed. An empty mapping (a model
    without coefficients) gives an empty array.
    """
    if not contributions:
        return "CAST(array() AS array<struct<feature:string,contribution:double,direction:string>>)"
    terms = ", ".join(f"struct(-abs({e}) AS k, {text(n)} AS feature, {e} AS contribution)" for n, e in contributions.items())
    return (f"transform(slice(array_sort(array({terms})), 1, {top_k}), t -> struct(t.feature AS feature, "
            "t.contribution AS contribution, IF(t.contribution >= 0, 'favor approval', 'favor rejection') AS direction))")


def reasons_long(df: DataFrame, id_col: str = ID, reasons: str = "reasons") -> DataFrame:
    """Reason codes as (id, rank, feature, contribution, direction)."""
    return df.selectExpr(id_col, f"posexplode({name(reasons)}) AS (pos, r)").selectExpr(
        id_col, "pos + 1 AS rank", "r.feature", "r.contribution", "r.direction")
