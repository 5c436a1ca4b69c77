"""Data-quality tables. Each is one aggregation over the applicant table, then a reshape of one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from underwright.functions.quantiles import exact_quantiles
from underwright.functions.ranking import window
from underwright.functions.scalars import long_rows, name, number, text, unpivot
from underwright.sources.contract import ID, ROW_SEQ, TARGET


def numeric_columns(df: DataFrame, skip: Sequence[str] = (TARGET, ROW_SEQ)) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def categorical_columns(df: DataFrame, skip: Sequence[str] = (ID,)) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def _copies(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies."""
    return df.groupBy(*df.columns).agg(F.expr("count(*) AS _n"))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns and surplus copies of equal rows."""
    return _copies(df).selectExpr(
        "coalesce(sum(_n), 0L) AS n_rows", f"{len(df.columns)}L AS n_columns",
        "coalesce(sum(_n - 1), 0L) AS duplicate_rows")


def _spelled(column: str, kind: T.DataType) -> str:
    """Text that is the same for equal values of the column and differs for others; null stays null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return f"CAST(CAST({name(column)} AS DOUBLE) + 0D AS STRING)"  # -0.0 equals 0.0
    if isinstance(kind, T.TimestampType):
        return f"CAST(unix_micros({name(column)}) AS STRING)"
    if isinstance(kind, T.BinaryType):
        return f"hex({name(column)})"
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return f"IF({name(column)} IS NULL, NULL, to_json(named_struct('v', {name(column)})))"
    return f"CAST({name(column)} AS STRING)"


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, non-null, missing, missing percent (2 digits), distinct values.

    Exact distinct values are counted in long form: each task adds up (column, value) pairs before the shuffle, so a value that
    most rows have is one pair per task. Columns of an empty table have zeros and no percentage.
    """
    types = {f.name: f.dataType for f in df.schema}
    percent = "round(try_divide({missing} * 100D, {n}), 2)"
    if approximate:
        row = df.selectExpr("count(*) AS _n", *[f"count({name(c)}) AS {name(c + '_n')}" for c in types], *[f"approx_count_distinct({name(c)}) AS {name(c + '_d')}" for c in types])
        return long_rows(row, [{
            "column": text(c), "dtype": text(kind.simpleString()), "non_null": name(c + "_n"), "missing": f"_n - {name(c + '_n')}",
            "missing_pct": percent.format(missing=f"(_n - {name(c + '_n')})", n="_n"), "distinct_values": name(c + "_d"),
        } for c, kind in types.items()])
    spelled = df.selectExpr(*[f"{_spelled(c, kind)} AS {name(c)}" for c, kind in types.items()])
    pairs = spelled.unpivot([], list(types), "column", "value").groupBy("column", "value").agg(F.expr("count(*) AS n"))
    counts = pairs.groupBy("column").agg(
        F.expr("sum(IF(value IS NULL, n, 0L)) AS missing"), F.expr("sum(n) AS n"), F.expr("count(value) AS distinct_values"))
    known = long_rows(df.sparkSession.range(1), [{"column": text(c), "dtype": text(kind.simpleString())} for c, kind in types.items()])
    return known.join(F.broadcast(counts), "column", "left").selectExpr(
        "column", "dtype", "coalesce(n - missing, 0L) AS non_null", "coalesce(missing, 0L) AS missing",
        f"{percent.format(missing='missing', n='n')} AS missing_pct", "coalesce(distinct_values, 0L) AS distinct_values")


def non_null_counts(df: DataFrame) -> DataFrame:
    """Per column: values that are present."""
    row = df.selectExpr(*[f"count({name(c)}) AS {name(c)}" for c in df.columns])
    return long_rows(row, [{"column": text(c), "n": name(c)} for c in df.columns])


def missing_counts(df: DataFrame) -> DataFrame:
    """Per column: missing values and percent, in one aggregation without distinct counts."""
    row = df.selectExpr("count(*) AS _n", *[f"count({name(c)}) AS {name(c + '_n')}" for c in df.columns])
    return long_rows(row, [{
        "column": text(c), "missing": f"_n - {name(c + '_n')}",
        "missing_pct": f"round(try_divide((_n - {name(c + '_n')}) * 100D, _n), 2)",
    } for c in df.columns])


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values, most affected first."""
    return missing_counts(df).filter("missing > 0").orderBy(F.desc("missing"), "column")


def duplicate_report(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Surplus copies of whole rows and of ids."""
    per_id = _copies(df).groupBy(id_col).agg(F.expr("sum(_n) AS n"), F.expr("count(*) AS variants"))
    return per_id.selectExpr("coalesce(sum(n - variants), 0L) AS duplicate_rows",
                             "coalesce(sum(n - 1), 0L) AS duplicate_ids")


def categorical_topn(df: DataFrame, top_n: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent values per categorical column; missing values are not counted."""
    columns = list(columns or categorical_columns(df))
    counts = unpivot(df, [], columns, "string").filter("value IS NOT NULL").groupBy("column", "value").agg(
        F.expr("count(*) AS n"))
    ranked = counts.selectExpr("*", f"row_number() {window(['column'], ['n DESC', 'value'])} AS rank")
    return ranked.filter(f"rank <= {top_n}")


def numeric_describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per numeric column."""
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75), exact)
    functions = {"n": "count", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    row = df.selectExpr(*[f"{f}({name(c)}) AS {name(f'{c}_{k}')}" for c in columns for k, f in functions.items()])
    entries = []
    for c in columns:
        q25, q50, q75 = (f"round({number(v)}, 2)" for v in quartiles[c])
        stats = {k: f"round(CAST({name(f'{c}_{k}')} AS DOUBLE), 2)" for k in ("mean", "std", "min", "max")}
        entries.append({"column": text(c), "n": name(f"{c}_n"), **stats, "q25": q25, "q50": q50, "q75": q75})
    return long_rows(row, entries)


def cell_missing_pct(df: DataFrame) -> DataFrame:
    """Share of missing cells over the whole table, in percent."""
    filled = " + ".join(f"count({name(c)})" for c in df.columns)
    return df.selectExpr(
        f"round(100D * (1 - try_divide({filled}, count(*) * {len(df.columns)})), 4) AS missing_cells_pct")


def dq_flags(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Raised data-quality flags as (flag, n); one row 'none' when nothing is wrong.

    Missing values are counted over the distinct rows with their copies, so one read gives all flags.
    """
    holes = {c: f"_m{k}" for k, c in enumerate(df.columns)}
    per_id = _copies(df).groupBy(F.col(id_col).alias("_id")).agg(
        F.expr("sum(_n) AS n"), F.expr("count(*) AS variants"), *[F.expr(f"sum(IF({name(c)} IS NULL, _n, 0L)) AS {m}") for c, m in holes.items()])
    row = per_id.selectExpr(
        "coalesce(sum(n - variants), 0L) AS duplicate_rows", "coalesce(sum(n - 1), 0L) AS duplicate_ids", *[f"coalesce(sum({m}), 0L) AS {m}" for m in holes.values()])
    counts = {**{f"missing:{c}": m for c, m in holes.items()}, "duplicate_rows": "duplicate_rows", "duplicate_ids": "duplicate_ids"}
    clean = f"IF(greatest({', '.join(counts.values())}) = 0, 0L, NULL)"
    flags = long_rows(row, [*({"flag": text(flag), "n": n} for flag, n in counts.items()), {"flag": text("none"), "n": clean}])
    return flags.filter("n > 0 OR flag = 'none' AND n IS NOT NULL")


def _class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(F.expr(f"{target} AS class")).agg(F.expr("count(*) AS n"))


def class_distribution(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Class share, 4 digits."""
    return _class_counts(df, target).selectExpr("class", "n", "round(n / sum(n) OVER (), 4) AS share")


def target_balance(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Class counts and percent, 2 digits."""
    return _class_counts(df, target).selectExpr("class", "n", "round(n * 100D / sum(n) OVER (), 2) AS pct")


def top_head(table: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """First k rows of a ranked result; the order must end in a tie-break."""
    return table.orderBy(*[F.expr(o[:-5]).desc() if o.endswith(" DESC") else F.expr(o) for o in order]).limit(k)
