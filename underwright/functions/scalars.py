"""Null-safe scalar expressions as Spark SQL text, for ``F.expr`` and ``selectExpr``.

Wide tables need hundreds of small expressions; as text each column costs one call into the JVM
instead of one per operator. NULL is the only missing value; NaN is turned into NULL on ingest.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Upper bounds of the default probability for each tier, in rising order.
RISK_TIERS = ((0.05, "Low Risk"), (0.15, "Medium Risk"), (0.30, "High Risk"))
TOP_RISK_TIER = "Very High Risk"


def number(x: float | None) -> str:
    """Double literal."""
    if x is None:
        return "CAST(NULL AS DOUBLE)"
    return f"{float(x)!r}D" if math.isfinite(x) else f"CAST('{float(x)!r}' AS DOUBLE)"


def text(x: str | None) -> str:
    """String literal."""
    return "CAST(NULL AS STRING)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(c: str) -> str:
    """Quoted column name."""
    return f"`{c}`"


def with_exprs(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """Append or replace columns from SQL text in one projection."""
    columns = df.columns
    replaced = [f"{exprs[c]} AS {name(c)}" if c in exprs else name(c) for c in columns]
    return df.selectExpr(*replaced, *[f"{e} AS {name(c)}" for c, e in exprs.items() if c not in columns])


def clip_null(c: str, lo: float, hi: float) -> str:
    """Clip to [lo, hi]; a missing value stays missing (``greatest`` alone would hide it)."""
    return f"CASE WHEN {c} IS NOT NULL THEN greatest({number(lo)}, least({c}, {number(hi)})) END"


def safe_div(a: str, b: str) -> str:
    """Quotient that is NULL for a zero denominator."""
    return f"try_divide({a}, {b})"


def flag(condition: str) -> str:
    """0/1 flag; an unknown condition counts as 0."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return with_exprs(df, {c: f"CASE WHEN NOT isnan({name(c)}) THEN {name(c)} END" for c in floating})


def hash_order(id_col: str, seed: int | str = 42) -> str:
    """Seeded text key that gives rows a reproducible random order."""
    return f"md5(concat_ws('|', CAST({id_col} AS STRING), {text(str(seed))}))"


def hash_fraction(*parts: str) -> str:
    """Reproducible uniform value in [0, 1): the first 8 hex digits of an MD5, as a share."""
    joined = ", ".join(f"CAST({p} AS STRING)" for p in parts)
    return f"(CAST(conv(substring(md5(concat_ws('|', {joined})), 1, 8), 16, 10) AS DOUBLE) / 4294967296D)"


def sigmoid(x: str) -> str:
    return f"(1D / (1D + exp(-({x}))))"


def log1p0(x: str) -> str:
    """log(1 + x) of the non-negative part of x."""
    return f"log1p(CASE WHEN {x} IS NOT NULL THEN greatest({x}, 0D) END)"


def rounded(x: str, digits: int = 6) -> str:
    """Half-up rounding without a negative zero."""
    return f"(round(CAST({x} AS DOUBLE), {digits}) + 0D)"


def risk_tier(p_default: str) -> str:
    """Tier of an unrounded default probability."""
    steps = " ".join(f"WHEN {p_default} < {number(bound)} THEN {text(label)}" for bound, label in RISK_TIERS)
    return f"CASE WHEN {p_default} IS NULL THEN NULL {steps} ELSE {text(TOP_RISK_TIER)} END"


def odds_ratio(coefficient: str) -> str:
    return f"round(exp({coefficient}), 3)"


def odds_effect(coefficient: str) -> str:
    return f"CASE WHEN {coefficient} > 0 THEN 'increases approval odds' ELSE 'decreases approval odds' END"


def zscore(df: DataFrame, columns: Iterable[str], epsilon: float = 1e-9) -> DataFrame:
    """Append ``<column>_z``: (x - mean) / (population std + epsilon), missing kept."""
    columns = list(columns)
    row = df.selectExpr(
        *[f"avg({name(c)}) AS {name(c + '_m')}" for c in columns],
        *[f"stddev_pop({name(c)}) AS {name(c + '_s')}" for c in columns],
    ).first()
    return with_exprs(df, {
        f"{c}_z": number(None) if row[f"{c}_m"] is None
        else f"({name(c)} - {number(row[f'{c}_m'])}) / {number(row[f'{c}_s'] + epsilon)}"
        for c in columns
    })


def unpivot(df: DataFrame, ids: list[str], columns: list[str], cast: str,
            label: str = "column", value: str = "value") -> DataFrame:
    """Wide to long over ``columns`` after casting them to one type."""
    typed = df.selectExpr(*map(name, ids), *[f"CAST({name(c)} AS {cast}) AS {name(c)}" for c in columns])
    return typed.unpivot(ids, columns, label, value)


def long_rows(row: DataFrame, entries: Iterable[Mapping[str, str]]) -> DataFrame:
    """Reshape a one-row aggregate: one output row per entry, ``entry`` maps column to SQL text."""
    structs = [f"named_struct({', '.join(f'{text(k)}, {e}' for k, e in entry.items())})" for entry in entries]
    return row.selectExpr(f"inline(array({', '.join(structs)}))")
