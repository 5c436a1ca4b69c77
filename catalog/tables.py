"""Queries on whole tables: profiles, distributions, correlations, default rates and splits."""

from __future__ import annotations

from catalog.registry import cleaned, raw, register, round_doubles, stored
from catalog.sql import CATEGORICAL, COLUMNS, NUMERIC, r, sql, stacked
from underwright.operators import eda, profiling, splits
from underwright.session import materialise
from underwright.sources.contract import APPLICANT_COLUMNS

_TYPES = dict(APPLICANT_COLUMNS)
_DUP_ROWS = "(SELECT count(*) FROM applicants) - (SELECT count(*) FROM (SELECT DISTINCT * FROM applicants))"
_DUP_IDS = "(SELECT count(*) - count(DISTINCT customer_id) FROM applicants)"
_BIG = "CAST({} AS BIGINT)".format

# --- profiles -------------------------------------------------------------------------------------

register("overview", sql(
    f"SELECT {_BIG('(SELECT count(*) FROM applicants)')} AS n_rows, {_BIG(len(COLUMNS))} AS n_columns, "
    f"{_BIG(_DUP_ROWS)} AS duplicate_rows", "applicants"))(lambda spark, sf: profiling.overview(raw(spark, sf)))

_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{_TYPES[c]}' AS dtype, {_BIG(f'count({c})')} AS non_null, "
    f"{_BIG(f'count(*) - count({c})')} AS missing, round((count(*) - count({c})) * 100e0 / count(*), 2) AS missing_pct, "
    f"{_BIG(f'count(DISTINCT {c})')} AS distinct_values FROM applicants" for c in COLUMNS)
register("column_profile", sql(_PROFILE, "applicants"))(lambda spark, sf: profiling.column_profile(raw(spark, sf)))
register("missing_report", sql(
    "SELECT \"column\", missing, missing_pct FROM prof WHERE missing > 0", "applicants", prof=_PROFILE))(
    lambda spark, sf: profiling.missing_report(raw(spark, sf)))
register("duplicate_report", sql(
    f"SELECT {_BIG(_DUP_ROWS)} AS duplicate_rows, {_BIG(_DUP_IDS)} AS duplicate_ids", "applicants"))(
    lambda spark, sf: profiling.duplicate_report(raw(spark, sf)))

_VALUES = stacked(CATEGORICAL, "SELECT '{c}' AS \"column\", {c} AS value, creditworthy FROM applicants")
_COUNTS = "SELECT \"column\", value, count(*) AS n FROM vals WHERE value IS NOT NULL GROUP BY ALL"
register("categorical_topn", sql(
    "SELECT \"column\", value, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER "
    "(PARTITION BY \"column\" ORDER BY n DESC, value) AS rank FROM counts) WHERE rank <= 5", "applicants", vals=_VALUES,
    counts=_COUNTS))(lambda spark, sf: profiling.categorical_topn(raw(spark, sf)))
register("top_head", sql(
    "SELECT \"column\", value, CAST(n AS BIGINT) AS n FROM counts ORDER BY n DESC, \"column\", value LIMIT 10", "applicants",
    vals=_VALUES, counts=_COUNTS))(
    lambda spark, sf: profiling.top_head(
        profiling.categorical_topn(raw(spark, sf), 100).select("column", "value", "n"), ["n DESC", "`column`", "value"], 10))

register("numeric_describe", sql(stacked(
    NUMERIC, "SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 2) AS mean, "
    "round(stddev_samp({c}), 2) AS std, round(min({c}), 2) AS min, round(max({c}), 2) AS max, "
    "round(quantile_cont({c}, 0.25), 2) AS q25, round(quantile_cont({c}, 0.5), 2) AS q50, "
    "round(quantile_cont({c}, 0.75), 2) AS q75 FROM applicants"), "applicants"))(
    lambda spark, sf: profiling.numeric_describe(materialise(raw(spark, sf), "raw")))
register("cell_missing_pct", sql(
    "SELECT round(100e0 * (1 - (" + " + ".join(f"count({c})" for c in COLUMNS) + f") * 1e0 / (count(*) * {len(COLUMNS)})), 4) "
    "AS missing_cells_pct FROM applicants", "applicants"))(lambda spark, sf: profiling.cell_missing_pct(raw(spark, sf)))
register("dq_flags", sql(
    f"SELECT concat('missing:', \"column\") AS flag, missing AS n FROM prof WHERE missing > 0 "
    f"UNION ALL SELECT 'duplicate_rows', {_BIG(_DUP_ROWS)} WHERE {_DUP_ROWS} > 0 "
    f"UNION ALL SELECT 'duplicate_ids', {_BIG(_DUP_IDS)} WHERE {_DUP_IDS} > 0", "applicants", prof=_PROFILE))(
    lambda spark, sf: profiling.dq_flags(raw(spark, sf)))
register("target_balance", sql(
    "SELECT creditworthy AS class, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM applicants), 2) "
    "AS pct FROM applicants GROUP BY 1", "applicants"))(lambda spark, sf: profiling.target_balance(raw(spark, sf)))
register("class_distribution", sql(
    "SELECT creditworthy AS class, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1e0 / (SELECT count(*) FROM cleaned), 4) "
    "AS share FROM cleaned GROUP BY 1", "cleaned"))(lambda spark, sf: profiling.class_distribution(cleaned(spark, sf)))

# --- distributions by class -----------------------------------------------------------------------

_NUMBERS = stacked(NUMERIC, "SELECT creditworthy AS class, '{c}' AS \"column\", {c} AS value FROM cleaned WHERE {c} IS NOT NULL")
register("class_histogram", sql(
    "SELECT class, \"column\", CAST(least(29, floor((value - lo) / w * 30)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n "
    "FROM vals JOIN rng USING (class, \"column\") GROUP BY 1, 2, 3", "cleaned", vals=_NUMBERS,
    rng="SELECT class, \"column\", CASE WHEN min(value) = max(value) THEN min(value) - 0.5e0 ELSE min(value) END AS lo, "
        "CASE WHEN min(value) = max(value) THEN 1e0 ELSE max(value) - min(value) END AS w FROM vals GROUP BY 1, 2"))(
    lambda spark, sf: eda.class_histogram(stored(spark, sf)))
register("class_box_stats", sql(
    f"SELECT class, \"column\", CAST(count(*) AS BIGINT) AS n, {r('min(q25)')} AS q25, {r('min(q50)')} AS q50, {r('min(q75)')} AS q75, "
    f"{r('min(CASE WHEN inside THEN value END)')} AS whisker_low, {r('max(CASE WHEN inside THEN value END)')} AS whisker_high, "
    "CAST(count(CASE WHEN NOT inside THEN 1 END) AS BIGINT) AS outliers FROM (SELECT *, value BETWEEN q25 - 1.5e0 * (q75 - q25) "
    "AND q75 + 1.5e0 * (q75 - q25) AS inside FROM vals JOIN q USING (class, \"column\")) GROUP BY 1, 2", "cleaned", vals=_NUMBERS,
    q="SELECT class, \"column\", quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, "
      "quantile_cont(value, 0.75) AS q75 FROM vals GROUP BY 1, 2"))(
    lambda spark, sf: round_doubles(eda.class_box_stats(stored(spark, sf))))

_DENSITY = ["credit_score", "credit_utilization_ratio", "interest_rate", "age", "monthly_income"]
register("class_density", sql(
    f"SELECT class, \"column\", CAST(point AS INTEGER) AS point, {r('min(lo + step * point)')} AS x, "
    f"{r('sum(exp(-0.5e0 * pow((lo + step * point - value) / h, 2))) / (min(n) * min(h) * sqrt(2 * pi()))')} AS density, "
    f"{r('min(median)')} AS median FROM vals JOIN st USING (class, \"column\") CROSS JOIN (SELECT unnest(range(0, 100)) AS point) "
    "GROUP BY 1, 2, 3", "cleaned",
    vals=stacked(_DENSITY, "SELECT creditworthy AS class, '{c}' AS \"column\", {c} AS value FROM cleaned WHERE {c} IS NOT NULL"),
    st="SELECT class, \"column\", count(*) AS n, pow(count(*), -0.2e0) * stddev_samp(value) AS h, min(value) AS lo, "
       "(max(value) - min(value)) / 99e0 AS step, median(value) AS median FROM vals GROUP BY 1, 2"))(
    lambda spark, sf: round_doubles(eda.class_density(stored(spark, sf), _DENSITY)))

# --- correlation ----------------------------------------------------------------------------------

_CORR = [*NUMERIC, "creditworthy"]
register("correlation_matrix", sql(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 4)} AS r FROM cleaned" if a != b else
    f"SELECT '{a}' AS a, '{b}' AS b, 1e0 AS r" for a in _CORR for b in _CORR), "cleaned"))(
    lambda spark, sf: round_doubles(eda.correlation_matrix(stored(spark, sf)), 4))
register("target_correlation", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'corr({c}, creditworthy)')} AS r FROM cleaned" for c in NUMERIC), "cleaned"))(
    lambda spark, sf: round_doubles(eda.target_correlation(cleaned(spark, sf))))

# --- categories -----------------------------------------------------------------------------------

_BY = ("SELECT \"column\", value, CAST(count(*) AS BIGINT) AS n, {rate} AS default_rate FROM vals GROUP BY 1, 2")
register("crosstab", sql(
    "SELECT \"column\", value, CAST(count(CASE WHEN creditworthy = 0 THEN 1 END) AS BIGINT) AS class_0, "
    "CAST(count(CASE WHEN creditworthy = 1 THEN 1 END) AS BIGINT) AS class_1 FROM vals GROUP BY 1, 2", "applicants", vals=_VALUES))(
    lambda spark, sf: eda.crosstab(raw(spark, sf)))
register("default_rate_by", sql(
    f"SELECT \"column\", value, CAST(count(*) AS BIGINT) AS n, {r('1 - avg(creditworthy)')} AS default_rate, "
    f"{r('(SELECT 1 - avg(creditworthy) FROM applicants)')} AS overall_rate FROM vals GROUP BY 1, 2", "applicants", vals=_VALUES))(
    lambda spark, sf: round_doubles(eda.default_rate_by(raw(spark, sf))))
register("category_extremes", sql(
    "SELECT \"column\", max(CASE WHEN h = 1 THEN value END) AS highest, max(CASE WHEN h = 1 THEN rate END) AS highest_rate, "
    "max(CASE WHEN l = 1 THEN value END) AS lowest, max(CASE WHEN l = 1 THEN rate END) AS lowest_rate FROM (SELECT *, "
    "row_number() OVER (PARTITION BY \"column\" ORDER BY rate DESC, value) AS h, row_number() OVER (PARTITION BY \"column\" "
    f"ORDER BY rate, value) AS l FROM (SELECT \"column\", value, {r('1 - avg(creditworthy)')} AS rate FROM vals GROUP BY 1, 2)) "
    "GROUP BY 1", "applicants", vals=_VALUES))(lambda spark, sf: round_doubles(eda.category_extremes(raw(spark, sf))))

# --- shape and outliers ---------------------------------------------------------------------------

_CENTRED = stacked(NUMERIC, "SELECT '{c}' AS feature, {c} - (SELECT avg({c}) FROM cleaned) AS d FROM cleaned WHERE {c} IS NOT NULL")
_SHAPE = ("SELECT feature, avg(d*d*d) / pow(avg(d*d), 1.5e0) AS s, avg(d*d*d*d) / pow(avg(d*d), 2) - 3 AS k FROM cent GROUP BY 1")
register("skew_kurtosis", sql(
    "SELECT feature, round(s, 3) AS skewness, round(k, 3) AS kurtosis, CASE WHEN abs(s) < 0.5e0 THEN 'approximately symmetric' "
    "WHEN abs(s) < 1e0 THEN 'moderately skewed' ELSE 'highly skewed' END AS shape FROM m", "cleaned", cent=_CENTRED, m=_SHAPE))(
    lambda spark, sf: eda.skew_kurtosis(cleaned(spark, sf)))
register("iqr_outliers", sql(
    "SELECT feature, round(min(lo), 2) AS lower, round(min(hi), 2) AS upper, CAST(count(CASE WHEN v < lo OR v > hi THEN 1 END) "
    "AS BIGINT) AS outliers, round(count(CASE WHEN v < lo OR v > hi THEN 1 END) * 100e0 / count(*), 2) AS outlier_pct FROM x GROUP BY 1",
    "cleaned", x=stacked(
        NUMERIC, "SELECT '{c}' AS feature, {c} AS v, q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM cleaned, "
        "(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM cleaned) WHERE {c} IS NOT NULL")))(
    lambda spark, sf: eda.iqr_outliers(stored(spark, sf)))

# --- splits ---------------------------------------------------------------------------------------

_RANKED = ("SELECT customer_id, creditworthy, row_number() OVER (PARTITION BY creditworthy ORDER BY md5(concat(customer_id, '|{seed}')), "
           "customer_id) AS rk, count(*) OVER (PARTITION BY creditworthy) AS n FROM cleaned")
SPLIT_SQL = ("SELECT customer_id, creditworthy, CASE WHEN rk <= nt THEN 'test' WHEN rk <= nt + round((n - nt) * {val}e0) THEN "
             "'validation' ELSE 'train' END AS split FROM (SELECT *, round(n * 0.2e0) AS nt FROM (" + _RANKED.format(seed=42) + "))")
register("stratified_split", sql(SPLIT_SQL.format(val=0.2), "cleaned"))(
    lambda spark, sf: splits.stratified_split(cleaned(spark, sf).select("customer_id", "creditworthy")))
register("holdout_80_20", sql(SPLIT_SQL.format(val=0), "cleaned"))(
    lambda spark, sf: splits.holdout_80_20(cleaned(spark, sf).select("customer_id", "creditworthy")))
register("stratified_kfold", sql(
    "SELECT customer_id, creditworthy, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM (" + _RANKED.format(seed=42) + ")", "cleaned"))(
    lambda spark, sf: splits.stratified_kfold(cleaned(spark, sf).select("customer_id", "creditworthy")))
register("split_report", sql(
    "SELECT split, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM s), 2) AS pct_of_total, "
    "round(avg(creditworthy), 4) AS class_1_share, round(1 - avg(creditworthy), 4) AS default_rate FROM s GROUP BY 1", "cleaned",
    s=SPLIT_SQL.format(val=0.2)))(
    lambda spark, sf: splits.split_report(splits.stratified_split(cleaned(spark, sf).select("customer_id", "creditworthy"))))
