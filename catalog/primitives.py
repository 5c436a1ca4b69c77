"""Queries on the shared building blocks, over the whole applicant table."""

from __future__ import annotations

from catalog.registry import cleaned, raw, register, round_doubles, scores
from catalog.sql import NUMERIC, clip, r, sql, stacked
from underwright.functions import scalars
from underwright.functions.quantiles import exact_quantiles
from underwright.functions.ranking import prefix_sum
from underwright.operators.scoring import check_columns
from underwright.session import materialise
from underwright.sources.contract import CONTRACT, MODEL_INPUTS

register("clip_null", sql(f"SELECT row_seq, {clip('monthly_income', '0e0', '50000e0')} AS v FROM applicants", "applicants"))(
    lambda spark, sf: raw(spark, sf).selectExpr("row_seq", f"{scalars.clip_null('monthly_income', 0, 50000)} AS v"))
register("safe_div", sql(f"SELECT row_seq, {r('total_assets / nullif(monthly_income, 0)')} AS v FROM applicants", "applicants"))(
    lambda spark, sf: raw(spark, sf).selectExpr(
        "row_seq", f"{scalars.rounded(scalars.safe_div('total_assets', 'monthly_income'))} AS v"))
register("flag", sql("SELECT row_seq, CASE WHEN credit_score > 700 THEN 1 ELSE 0 END AS v FROM applicants", "applicants"))(
    lambda spark, sf: raw(spark, sf).selectExpr("row_seq", f"{scalars.flag('credit_score > 700')} AS v"))
register("hash_order", sql("SELECT row_seq, md5(concat(customer_id, '|42')) AS h FROM applicants", "applicants"))(
    lambda spark, sf: raw(spark, sf).selectExpr("row_seq", f"{scalars.hash_order('customer_id', 42)} AS h"))

_PROBS = (0.01, 0.25, 0.5, 0.9, 0.99)


@register("exact_quantiles", sql(stacked(
    NUMERIC, "SELECT '{c}' AS \"column\", " + ", ".join(
        f"{r(f'quantile_cont({{c}}, {q})')} AS q{round(q * 100)}" for q in _PROBS) + " FROM cleaned"), "cleaned"))
def _exact_quantiles(spark, sf):
    """The interval-narrowing path, whatever the row count."""
    rows = materialise(cleaned(spark, sf).select(*NUMERIC), "numbers")
    found = exact_quantiles(rows, NUMERIC, _PROBS)
    names = ", ".join(f"q{round(q * 100)} double" for q in _PROBS)
    return round_doubles(spark.createDataFrame([(c, *map(float, v)) for c, v in found.items()], f"`column` string, {names}"))


@register("prefix_sum", sql(
    "SELECT customer_id, p, CAST(sum(y) OVER o AS BIGINT) AS good, CAST(sum(y) OVER () AS BIGINT) AS total FROM scored WINDOW o AS "
    "(ORDER BY p, customer_id ROWS UNBOUNDED PRECEDING)", "scored"))
def _prefix_sum(spark, sf):
    rows = scores(spark, sf).selectExpr("customer_id", "p", "CAST(y AS BIGINT) AS y", "coalesce(CAST(floor(p * 1000) AS BIGINT), 0L) AS b")
    return prefix_sum(rows, {"good": "y"}, ["p", "customer_id"], ["b"], (), {"total": "y"}).select("customer_id", "p", "good", "total")


register("unpivot", sql(stacked(
    NUMERIC, "SELECT row_seq, '{c}' AS \"column\", {c} AS value FROM applicants"), "applicants"))(
    lambda spark, sf: scalars.unpivot(raw(spark, sf), ["row_seq"], list(NUMERIC), "double"))
register("odds_ratio", sql(
    "SELECT customer_id, round(exp((p - 0.5e0) * 4), 3) AS odds, CASE WHEN p > 0.5e0 THEN 'increases approval odds' ELSE "
    "'decreases approval odds' END AS effect FROM scored", "scored"))(
    lambda spark, sf: scores(spark, sf).selectExpr(
        "customer_id", f"{scalars.odds_ratio('(p - 0.5D) * 4')} AS odds", f"{scalars.odds_effect('p - 0.5D')} AS effect"))


@register("check_columns", sql(
    f"SELECT CAST({len(CONTRACT)} AS BIGINT) AS required, CAST(count(*) AS BIGINT) AS n FROM applicants", "applicants"))
def _check_columns(spark, sf):
    rows = raw(spark, sf)
    check_columns(rows)
    return rows.selectExpr(f"{len(MODEL_INPUTS)}L AS required", "count(*) AS n")
