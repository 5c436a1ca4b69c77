"""Numbers behind the exploratory figures: distributions, correlations and default rates by class."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.quantiles import exact_quantiles
from underwright.functions.scalars import long_rows, name, number, text, unpivot
from underwright.operators.profiling import categorical_columns, numeric_columns
from underwright.sources.contract import TARGET

CLASSES = (0, 1)
HISTOGRAM_BINS = 30
DENSITY_POINTS = 100


def _class_values(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Long form (class, column, value) without missing values."""
    return unpivot(df.withColumnRenamed(target, "class"), ["class"], list(columns), "double").filter("value IS NOT NULL")


def _per_class(columns: Sequence[str], target: str) -> dict[str, str]:
    return {f"{k}|{c}": f"CASE WHEN {target} = {k} THEN {name(c)} END" for k in CLASSES for c in columns}


def _constants(table: Mapping[str, Sequence[float | None]], names: Sequence[str]) -> str:
    """Lookup of constants by class and column; the map has one entry per class and column."""
    pairs = [
        f"{text(key)}, struct({', '.join(f'{number(v)} AS {n}' for n, v in zip(names, values))})"
        for key, values in table.items()
    ]
    return f"map({', '.join(pairs)})[concat_ws('|', class, column)]"


def _class_ranges(values: DataFrame, *more: str) -> list:
    return values.groupBy("class", "column").agg(
        F.expr("min(value) AS lo"), F.expr("max(value) AS hi"), *[F.expr(e) for e in more]).collect()


def class_histogram(df: DataFrame, columns: Sequence[str] | None = None, target: str = TARGET,
                    bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins per class over that class's own range; the last bin is closed.

    A constant column is binned over one unit around its value.
    """
    columns = list(columns or numeric_columns(df))
    values = _class_values(df, columns, target)
    ranges = {}
    for r in _class_ranges(values):
        low, high = (r["lo"], r["hi"]) if r["lo"] < r["hi"] else (r["lo"] - 0.5, r["lo"] + 0.5)
        ranges[f"{r['class']}|{r['column']}"] = (low, high - low)
    located = values.selectExpr("*", f"{_constants(ranges, ('lo', 'width'))} AS b")
    cell = f"CAST(least({bins - 1}, floor((value - b.lo) / b.width * {bins})) AS INT) AS bin"
    return located.groupBy("class", "column", F.expr(cell)).agg(F.expr("count(*) AS n"))


def class_box_stats(df: DataFrame, columns: Sequence[str] | None = None, target: str = TARGET) -> DataFrame:
    """Quartiles, whiskers at the last point within 1.5 IQR, outlier count, per class and column."""
    columns = list(columns or numeric_columns(df))
    table = exact_quantiles(df, _per_class(columns, target), (0.25, 0.5, 0.75))
    lookup = f"{_constants(table, ('q25', 'q50', 'q75'))} AS q"
    rows = _class_values(df, columns, target).selectExpr("*", lookup).selectExpr(
        "class", "column", "value",
        "value BETWEEN q.q25 - 1.5D * (q.q75 - q.q25) AND q.q75 + 1.5D * (q.q75 - q.q25) AS inside")
    stats = rows.groupBy("class", "column").agg(
        F.expr("count(*) AS n"), F.expr("min(IF(inside, value, NULL)) AS whisker_low"),
        F.expr("max(IF(inside, value, NULL)) AS whisker_high"), F.expr("count_if(NOT inside) AS outliers"))
    return stats.selectExpr("*", lookup).selectExpr(
        "class", "column", "n", "q.q25", "q.q50", "q.q75", "whisker_low", "whisker_high", "outliers")


def class_density(df: DataFrame, columns: Sequence[str], target: str = TARGET,
                  points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on an even grid per class, plus the class median.

    Each task adds up its values on the grid, so a few rows per class and column and task are shuffled, whatever
    the number of values. Classes with fewer than two different values have no density.
    """
    columns = list(columns)
    medians = exact_quantiles(df, _per_class(columns, target), (0.5,))
    values = _class_values(df, columns, target)
    facts = []
    for r in _class_ranges(values, "count(*) AS n", "stddev_samp(value) AS sd"):
        if r["sd"]:
            width, step = r["n"] ** -0.2 * r["sd"], (r["hi"] - r["lo"]) / (points - 1)
            facts.append((len(facts), r["class"], r["column"], float(r["n"]), width, r["lo"], step, medians[f"{r['class']}|{r['column']}"][0]))
    lookup = _constants({f"{f[1]}|{f[2]}": (f[0],) for f in facts}, ("grid",)) if facts else "named_struct('grid', CAST(NULL AS DOUBLE))"
    located = values.selectExpr(f"CAST({lookup}.grid AS INT) AS grid", "value").filter("grid IS NOT NULL")
    grids = {f[0]: (f[4], f[5] + f[6] * np.arange(points)) for f in facts}

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for grid, part in frame.groupby("grid")["value"]:
                width, at = grids[grid]
                value, weight = np.unique(part.to_numpy(), return_counts=True)
                kernel = np.exp(-0.5 * ((at[:, None] - value) / width) ** 2)
                total[grid] = total.get(grid, 0.0) + kernel @ weight
        for grid, s in total.items():
            yield pd.DataFrame({"grid": np.int32(grid), "point": np.arange(points, dtype=np.int32), "s": s})

    parts = located.mapInPandas(sums, "grid int, point int, s double").groupBy("grid", "point").agg(F.expr("sum(s) AS s"))
    known = df.sparkSession.createDataFrame(facts, f"grid int, class {dict(values.dtypes)['class']}, column string, n double, h double, lo double, step double, median double")
    return parts.join(F.broadcast(known), "grid").selectExpr(
        "class", "column", "point", "lo + step * point AS x", "s / (n * h * sqrt(2 * pi())) AS density", "median")


MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centred sums for every column pair over the rows where both are present.

    Each task reduces its Arrow batches to a few small matrix products and emits one row per column
    pair; the shuffle adds those up. Columns are centred on their means first to keep the sums
    accurate.
    """
    columns = list(columns)
    means = df.selectExpr(*[f"avg({name(c)}) AS {name(c)}" for c in columns]).first()
    centred = df.selectExpr(*[f"CAST({name(c)} AS DOUBLE) - {number(means[c] or 0.0)} AS {name(c)}" for c in columns])
    first, second = np.triu_indices(len(columns), 1)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            x = frame.to_numpy(dtype=float)
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            cut = total[:, first, second]
            yield pd.DataFrame({"i": first, "j": second, **dict(zip(MOMENTS, cut))})

    parts = centred.mapInPandas(sums, "i int, j int, " + ", ".join(f"{c} double" for c in MOMENTS))
    names = f"array({', '.join(map(text, columns))})"
    return parts.groupBy("i", "j").agg(*[F.expr(f"sum({c}) AS {c}") for c in MOMENTS]).selectExpr(
        f"{names}[i] AS a", f"{names}[j] AS b", *MOMENTS)


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair (a, b, r), pairwise complete; NULL for a constant column."""
    parts = pair_moments(df, columns).filter("n > 0").selectExpr(
        "a", "b", "sxy - sx * sy / n AS cov", "sxx - sx * sx / n AS vx", "syy - sy * sy / n AS vy", "sxx", "syy")
    return parts.selectExpr("a", "b", "CASE WHEN vx > 1e-12D * sxx AND vy > 1e-12D * syy THEN cov / sqrt(vx * vy) END AS r")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, target: str = TARGET) -> DataFrame:
    """Full symmetric matrix in long form (a, b, r), numeric columns and target."""
    columns = [*(columns or numeric_columns(df)), target]
    mirrored = pearson_pairs(df, columns).selectExpr(
        "inline(array(named_struct('a', a, 'b', b, 'r', r), named_struct('a', b, 'b', a, 'r', r)))")
    varies = df.selectExpr(*[f"stddev_pop({name(c)}) > 0 AS {name(c)}" for c in columns])
    diagonal = long_rows(varies, [
        {"a": text(c), "b": text(c), "r": f"CASE WHEN {name(c)} THEN 1D END"} for c in columns])
    return mirrored.unionByName(diagonal)


def target_correlation(df: DataFrame, columns: Sequence[str] | None = None, target: str = TARGET) -> DataFrame:
    """Features by absolute correlation with the target."""
    columns = list(columns or numeric_columns(df))
    row = df.selectExpr(*[f"corr(CAST({name(c)} AS DOUBLE), CAST({target} AS DOUBLE)) AS {name(c)}" for c in columns])
    return long_rows(row, [{"feature": text(c), "r": name(c)} for c in columns]).orderBy(F.expr("abs(r)").desc(), "feature")


def _category_counts(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Rows of both classes per category of every column, in one pass."""
    return unpivot(df, [target], list(columns), "string").filter("value IS NOT NULL").groupBy("column", "value").agg(
        F.expr(f"count_if({target} = 0) AS class_0"), F.expr(f"count_if({target} = 1) AS class_1"))


def crosstab(df: DataFrame, columns: Sequence[str] | None = None, target: str = TARGET) -> DataFrame:
    """Category by class counts for every categorical column."""
    return _category_counts(df, columns or categorical_columns(df), target)


def default_rate_by(df: DataFrame, columns: Sequence[str] | None = None, target: str = TARGET) -> DataFrame:
    """Default rate per category next to the rate of the whole table, worst first.

    The whole table's rate is a one-row aggregate; an empty table gives no rows.
    """
    columns = list(columns or categorical_columns(df))
    overall = df.selectExpr(f"try_divide(count_if({target} = 0), count_if({target} IN (0, 1))) AS rate").first()["rate"]
    rates = _category_counts(df, columns, target).selectExpr(
        "column", "value", "class_0 + class_1 AS n", "class_0 / (class_0 + class_1) AS default_rate")
    return rates.selectExpr("*", f"{number(overall)} AS overall_rate").orderBy("column", F.desc("default_rate"), "value")


def category_extremes(df: DataFrame, columns: Sequence[str] | None = None, target: str = TARGET) -> DataFrame:
    """Riskiest and safest category of each column; the first name wins a tie."""
    rates = _category_counts(df, columns or categorical_columns(df), target).selectExpr(
        "column", "value", "class_0 / (class_0 + class_1) AS rate")
    return rates.groupBy("column").agg(
        F.expr("min(struct(-rate AS k, value, rate)) AS hi"), F.expr("min(struct(rate AS k, value)) AS lo")).selectExpr(
        "column", "hi.value AS highest", "hi.rate AS highest_rate", "lo.value AS lowest", "lo.k AS lowest_rate")


def skew_label(skew: str) -> str:
    return (f"CASE WHEN abs({skew}) < 0.5D THEN 'approximately symmetric' WHEN abs({skew}) < 1D THEN 'moderately skewed' "
            f"WHEN {skew} IS NOT NULL THEN 'highly skewed' END")


def skew_kurtosis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Population skewness and excess kurtosis (3 digits) with a label, most skewed first."""
    columns = list(columns or numeric_columns(df))
    row = df.selectExpr(*[f"{f}({name(c)}) AS {name(f'{c}_{f}')}" for c in columns for f in ("skewness", "kurtosis")])
    return long_rows(row, [{
        "feature": text(c), "skewness": f"round({name(c + '_skewness')}, 3)", "kurtosis": f"round({name(c + '_kurtosis')}, 3)",
        "shape": skew_label(name(c + "_skewness")),
    } for c in columns]).orderBy(F.expr("abs(skewness)").desc(), "feature")


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Tukey bounds, outlier count and percent of the non-null rows, most affected first."""
    columns = list(columns or numeric_columns(df))
    bounds = {
        c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        for c, (q1, q3) in exact_quantiles(df, columns, (0.25, 0.75)).items() if q1 is not None
    }
    row = df.selectExpr(*[
        e for c, (lo, hi) in bounds.items() for e in (
            f"count({name(c)}) AS {name(c + '_n')}",
            f"count_if({name(c)} < {number(lo)} OR {name(c)} > {number(hi)}) AS {name(c + '_o')}")])
    return long_rows(row, [{
        "feature": text(c), "lower": f"round({number(lo)}, 2)", "upper": f"round({number(hi)}, 2)",
        "outliers": name(c + "_o"), "outlier_pct": f"round({name(c + '_o')} * 100D / {name(c + '_n')}, 2)",
    } for c, (lo, hi) in bounds.items()]).orderBy(F.desc("outlier_pct"), "feature")
