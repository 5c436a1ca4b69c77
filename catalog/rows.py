"""Queries on single rows: sources, cleaning, features, scoring and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import cleaned, features, raw, register, round_doubles, scores
from catalog.sql import (
    CLEAN_RULES, COLUMNS, COMPOSITES, FEATURE_NAMES, MONEY, RATIOS, r, sql,
)
from underwright.functions import scalars
from underwright.functions.scalars import hash_order, rounded, with_exprs
from underwright.operators import cleaning, profiling, scoring
from underwright.sources import scorecard as card
from underwright.sources.applicants import table
from underwright.sources.contract import CONTRACT, MODEL_INPUTS

# --- sources --------------------------------------------------------------------------------------

register("scan_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
register("applicants", sql("SELECT * FROM applicants", "applicants"))(raw)

# --- cleaning -------------------------------------------------------------------------------------

register("dedup_rows", sql("SELECT DISTINCT * FROM applicants", "applicants"))(
    lambda spark, sf: cleaning.dedup_rows(raw(spark, sf)))
register("dedup_key", sql("SELECT * FROM dedup", "dedup"))(lambda spark, sf: cleaning.dedup_key(raw(spark, sf)))


def _rule(name, columns, apply):
    select = ", ".join(f"{CLEAN_RULES[c]} AS {c}" for c in columns)
    register(name, sql(f"SELECT row_seq, customer_id, {select} FROM applicants", "applicants"))(
        lambda spark, sf: apply(raw(spark, sf).select("row_seq", "customer_id", *columns)))


_rule("null_underage", ["age"], cleaning.null_underage)
_rule("clip_score", ["credit_score"], lambda df: cleaning.clip_column(df, "credit_score"))
_rule("clip_util", ["credit_utilization_ratio"], lambda df: cleaning.clip_column(df, "credit_utilization_ratio"))
_rule("clip_rate", ["interest_rate"], lambda df: cleaning.clip_column(df, "interest_rate"))
_rule("null_bad_term", ["loan_term_months"], cleaning.null_bad_term)
_rule("null_negative_money", list(MONEY), cleaning.null_negative_money)
_rule("floor_dependents", ["dependents"], cleaning.floor_dependents)
register("clean_applicants", sql("SELECT * FROM cleaned", "cleaned"))(cleaned)

_LOG = {
    "rows_before": "SELECT count(*) FROM applicants",
    "duplicate_rows": "SELECT (SELECT count(*) FROM applicants) - count(*) FROM (SELECT DISTINCT * FROM applicants)",
    "duplicate_ids": "SELECT count(*) - count(DISTINCT customer_id) FROM (SELECT DISTINCT * FROM applicants)",
    "age_under_18": "SELECT count(*) FROM dedup WHERE age < 18",
    "credit_score_clipped": "SELECT count(*) FROM dedup WHERE credit_score < 300 OR credit_score > 850",
    "credit_utilization_ratio_clipped":
        "SELECT count(*) FROM dedup WHERE credit_utilization_ratio < 0 OR credit_utilization_ratio > 1.5",
    "interest_rate_clipped": "SELECT count(*) FROM dedup WHERE interest_rate < 0 OR interest_rate > 40",
    "loan_term_months_not_positive": "SELECT count(*) FROM dedup WHERE loan_term_months <= 0",
    **{f"{c}_negative": f"SELECT count(*) FROM dedup WHERE {c} < 0" for c in MONEY},
    "dependents_negative": "SELECT count(*) FROM dedup WHERE dependents < 0",
    "rows_after": "SELECT count(*) FROM dedup",
}
register("clean_change_log", sql(
    " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(({q}) AS BIGINT) AS n" for k, q in _LOG.items()), "dedup"))(
    lambda spark, sf: cleaning.clean_change_log(raw(spark, sf)))

_INPUT_ORDER = [c for c in COLUMNS if c not in ("row_seq", "customer_id", "gender", "marital_status", "creditworthy")]
register("prepare_features", sql(f"SELECT {', '.join(_INPUT_ORDER)}, creditworthy AS label FROM cleaned", "cleaned"))(
    lambda spark, sf: cleaning.prepare_features(cleaned(spark, sf)))

_PICK = ["dti_ratio", "credit_score", "risk_index", "no_such_column", "loan_amount"]
register("select_features", sql(
    f"SELECT customer_id, {r('dti_ratio')} AS dti_ratio, credit_score, {r('risk_index')} AS risk_index, loan_amount "
    "FROM features", "features"))(
    lambda spark, sf: round_doubles(cleaning.select_features(features(spark, sf), _PICK, ("customer_id",))[0]))

_TYPED = {"age": "DOUBLE", "credit_score": "DOUBLE", "monthly_income": "DOUBLE", "creditworthy": "INTEGER"}
register("enforce_types", sql(
    "SELECT customer_id, " + ", ".join(f"try_cast({c} AS {t}) AS {c}" for c, t in _TYPED.items()) + " FROM t",
    "applicants",
    t="SELECT customer_id, CASE WHEN age < 18 THEN 'minor' ELSE CAST(age AS VARCHAR) END AS age, "
      "CAST(credit_score AS VARCHAR) AS credit_score, CAST(monthly_income AS VARCHAR) AS monthly_income, "
      "CAST(creditworthy AS VARCHAR) AS creditworthy FROM applicants"))(
    lambda spark, sf: cleaning.enforce_types(raw(spark, sf).selectExpr(
        "customer_id", "IF(age < 18, 'minor', CAST(age AS STRING)) AS age",
        *[f"CAST({c} AS STRING) AS {c}" for c in ("credit_score", "monthly_income", "creditworthy")])))

register("sample_rows", sql(
    "SELECT customer_id, credit_score, monthly_income FROM cleaned ORDER BY md5(concat(customer_id, '|42')) LIMIT 800",
    "cleaned"))(
    lambda spark, sf: cleaned(spark, sf).select("customer_id", "credit_score", "monthly_income").orderBy(
        F.expr(hash_order("customer_id", 42)), "customer_id").limit(800))

# --- features -------------------------------------------------------------------------------------


def _feature(name):
    digits = name not in ("maxed_out_flag", "has_delinquency_history", "credit_tier")
    register(name, sql(f"SELECT customer_id, {r(name) if digits else name} AS {name} FROM features", "features"))(
        lambda spark, sf: round_doubles(features(spark, sf).select("customer_id", name)))


for _name in FEATURE_NAMES:
    _feature(_name)
_ALL = [r(c) + f" AS {c}" if c in RATIOS and c not in ("maxed_out_flag", "has_delinquency_history", "credit_tier")
        or c in COMPOSITES else c for c in (*COLUMNS, *FEATURE_NAMES)]
register("engineer_features", sql(f"SELECT {', '.join(_ALL)} FROM features", "features"))(
    lambda spark, sf: with_exprs(
        features(spark, sf), {c: rounded(c) for c in FEATURE_NAMES if c not in ("maxed_out_flag", "has_delinquency_history", "credit_tier")}))

_RATIO_NAMES = ("dti_ratio", "loan_monthly_burden", "savings_to_income", "credit_inquiry_density")


@register("inf_to_null", sql(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(count(CASE WHEN isinf({c}) THEN 1 END) AS BIGINT) AS infinite, "
        f"CAST(count(CASE WHEN {c} IS NULL THEN 1 END) AS BIGINT) AS missing FROM features" for c in _RATIO_NAMES),
    "features"))
def _inf_to_null(spark, sf):
    row = features(spark, sf).selectExpr(
        *[f"count_if(abs({c}) = double('infinity')) AS {c}_i" for c in _RATIO_NAMES],
        *[f"count_if({c} IS NULL) AS {c}_m" for c in _RATIO_NAMES])
    return scalars.long_rows(row, [
        {"feature": f"'{c}'", "infinite": f"{c}_i", "missing": f"{c}_m"} for c in _RATIO_NAMES])


register("sigmoid", sql(
    f"SELECT customer_id, {r('1e0 / (1e0 + exp(-(credit_score - 600) / 100e0))')} AS p FROM cleaned", "cleaned"))(
    lambda spark, sf: cleaned(spark, sf).selectExpr(
        "customer_id", f"{rounded(scalars.sigmoid('(credit_score - 600) / 100'))} AS p"))
register("zscore", sql(
    f"SELECT customer_id, {r('(credit_score - m1) / (s1 + 1e-9)')} AS credit_score_z, "
    f"{r('(loan_amount - m2) / (s2 + 1e-9)')} AS loan_amount_z FROM cleaned CROSS JOIN st", "cleaned",
    st="SELECT avg(credit_score) AS m1, stddev_pop(credit_score) AS s1, avg(loan_amount) AS m2, "
       "stddev_pop(loan_amount) AS s2 FROM cleaned"))(
    lambda spark, sf: round_doubles(scalars.zscore(
        cleaned(spark, sf).select("customer_id", "credit_score", "loan_amount"), ["credit_score", "loan_amount"]).select(
        "customer_id", "credit_score_z", "loan_amount_z")))
register("log1p0", sql(
    f"SELECT row_seq, {r('ln(1 + CASE WHEN monthly_income IS NOT NULL THEN greatest(monthly_income, 0e0) END)')} AS log_income "
    "FROM applicants", "applicants"))(
    lambda spark, sf: raw(spark, sf).selectExpr("row_seq", f"{rounded(scalars.log1p0('monthly_income'))} AS log_income"))

# --- scoring --------------------------------------------------------------------------------------

_TIER = ("CASE WHEN 1 - p < 0.05e0 THEN 'Low Risk' WHEN 1 - p < 0.15e0 THEN 'Medium Risk' "
         "WHEN 1 - p < 0.3e0 THEN 'High Risk' ELSE 'Very High Risk' END")
_DECISION = "CASE WHEN p >= 0.64e0 THEN 'Approve' ELSE 'Reject' END"
_SCORED = (f"SELECT customer_id, round(p, 4) AS p_creditworthy, round(1 - p, 4) AS p_default, {_DECISION} AS decision, "
           f"{_TIER} AS risk_tier FROM scored_raw")
register("risk_tier", sql(f"SELECT customer_id, {_TIER} AS risk_tier FROM scored", "scored"))(
    lambda spark, sf: scores(spark, sf).selectExpr("customer_id", f"{scalars.risk_tier('(1 - p)')} AS risk_tier"))
register("score_applicants", sql(_SCORED, "scored_raw"))(
    lambda spark, sf: scoring.score_applicants(card.scorecard_inputs(raw(spark, sf)), card.probability(digits=None)))
register("score_attach", sql(
    f"SELECT s.customer_id, d.loan_amount, s.y, round(s.p, 4) AS p_creditworthy, {_DECISION} AS decision "
    "FROM scored_raw s JOIN dedup d ON d.customer_id = s.customer_id", "scored_raw", "dedup"))(
    lambda spark, sf: with_exprs(
        cleaning.dedup_key(raw(spark, sf)), {"p": card.probability(card.TERM_INPUTS, digits=None)}).selectExpr(
        "customer_id", "loan_amount", "creditworthy AS y", "round(p, 4) AS p_creditworthy",
        "IF(p >= 0.64D, 'Approve', 'Reject') AS decision"))
register("decision_counts", sql(
    f"SELECT decision, CAST(count(*) AS BIGINT) AS n FROM ({_SCORED}) GROUP BY decision", "scored_raw"))(
    lambda spark, sf: scoring.decision_counts(
        scoring.score_applicants(card.scorecard_inputs(raw(spark, sf)), card.probability(digits=None))))

_CARD_SQL = (
    "SELECT customer_id, creditworthy, coalesce(CASE WHEN credit_score IS NOT NULL THEN greatest(300e0, least(credit_score, 850e0)) END, 600e0) AS score, "
    "coalesce(CASE WHEN credit_utilization_ratio IS NOT NULL THEN greatest(0e0, least(credit_utilization_ratio, 1.5e0)) END, 0.5e0) AS util, "
    "coalesce((1 - greatest(0e0, least(num_late_payments_12m / 12e0, 1e0))) * (1 - 0.2e0 * greatest(0e0, least(num_previous_defaults, 5e0))), 0.9e0) AS pc, "
    "least(coalesce(CASE WHEN monthly_debt_payment >= 0 AND monthly_income > 0 THEN monthly_debt_payment / monthly_income END, 0.2e0), 2e0) AS dti "
    "FROM dedup")
_TERM_SQL = {"score": "0.006e0 * (score - 600e0)", "util": "-2e0 * (util - 0.5e0)", "pc": "4e0 * (pc - 0.9e0)",
             "dti": "-1e0 * (dti - 0.2e0)"}
_CONTRIB_SQL = " UNION ALL ".join(
    f"SELECT customer_id, '{t}' AS feature, {r(e)} AS contribution FROM card" for t, e in _TERM_SQL.items())


@register("reason_codes", sql(
    "SELECT customer_id, CAST(rank AS INTEGER) AS rank, feature, contribution, CASE WHEN contribution >= 0 THEN 'favor approval' "
    "ELSE 'favor rejection' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY "
    "abs(contribution) DESC, feature) AS rank FROM contrib) WHERE rank <= 3", "dedup", card=_CARD_SQL,
    contrib=_CONTRIB_SQL))
def _reason_codes(spark, sf):
    inputs = card.scorecard_inputs(raw(spark, sf))
    terms = {t: rounded(card.term_contribution(t)) for t in card.TERM_NAMES}
    return scoring.reasons_long(with_exprs(inputs, {"reasons": scoring.reason_codes(terms, 3)}))


@register("pick_scenarios", sql(
    "SELECT scenario, customer_id, y, p FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY customer_id) AS rn "
    "FROM (SELECT CASE WHEN p >= 0.64e0 AND y = 1 THEN 'approved_good' WHEN p < 0.64e0 AND y = 0 THEN 'rejected_bad' END "
    "AS scenario, customer_id, y, p FROM scored) WHERE scenario IS NOT NULL) WHERE rn = 1", "scored"))
def _pick_scenarios(spark, sf):
    from underwright.operators.explain import pick_scenarios

    return pick_scenarios(scores(spark, sf), 0.64)


# --- validation -----------------------------------------------------------------------------------

_RULE_ROWS = []
for _c in CONTRACT:
    if _c.kind == "numeric":
        _RULE_ROWS.append((_c.feature, "below_minimum", f"{_c.feature} < {_c.minimum:g}e0"))
        if _c.maximum is not None:
            _RULE_ROWS.append((_c.feature, "above_maximum", f"{_c.feature} > {_c.maximum:g}e0"))
_BROKEN = " UNION ALL ".join(
    f"SELECT customer_id, row_seq, '{f}' AS feature, '{rule}' AS rule, {f} AS value FROM applicants WHERE {cond}"
    for f, rule, cond in _RULE_ROWS)
register("range_check", sql("SELECT customer_id, feature, rule, value FROM broken", "applicants", broken=_BROKEN))(
    lambda spark, sf: scoring.range_check(raw(spark, sf)).selectExpr(
        "customer_id", "feature", "rule", "CAST(value AS DOUBLE) AS value"))

_TEXT = "CASE WHEN age < 20 THEN concat('age ', customer_id) ELSE CAST(age AS VARCHAR) END"
register("coerce_numeric", sql(
    f"SELECT customer_id, 'age' AS feature, 'not_numeric' AS rule, {_TEXT} AS value FROM applicants "
    f"WHERE {_TEXT} IS NOT NULL AND try_cast({_TEXT} AS DOUBLE) IS NULL", "applicants"))(
    lambda spark, sf: scoring.coerce_numeric(with_exprs(
        raw(spark, sf), {"age": "IF(age < 20, concat('age ', customer_id), CAST(age AS STRING))"})))

_MARK = "CASE WHEN credit_score < 400 THEN 'Space Travel' ELSE loan_purpose END"
register("unknown_category", sql(
    f"SELECT customer_id, 'loan_purpose' AS feature, {_MARK} AS value FROM applicants WHERE {_MARK} = 'Space Travel'",
    "applicants"))(
    lambda spark, sf: scoring.unknown_category(with_exprs(
        raw(spark, sf), {"loan_purpose": "IF(credit_score < 400, 'Space Travel', loan_purpose)"})))

register("validation_summary", sql(
    "SELECT feature, rule, CAST(max(n) AS BIGINT) AS n, concat('''', feature, ''' ', rule, ': ', "
    "string_agg(customer_id, ', ' ORDER BY customer_id, row_seq)) AS message FROM (SELECT *, count(*) OVER (PARTITION BY feature, rule) AS n, "
    "row_number() OVER (PARTITION BY feature, rule ORDER BY customer_id, row_seq) AS rn FROM broken) WHERE rn <= 3 GROUP BY feature, rule",
    "applicants", broken=_BROKEN))(
    lambda spark, sf: scoring.summarise_violations(
        scoring.contract_violations(raw(spark, sf)).withColumn("value", F.col("customer_id"))))


#: The same with the values that the messages show.
register("validation_messages", sql(
    "SELECT feature, rule, CAST(max(n) AS BIGINT) AS n, concat('''', feature, ''' ', rule, ': ', "
    "string_agg(shown, ', ' ORDER BY customer_id, shown)) AS message FROM (SELECT *, count(*) OVER (PARTITION BY feature, rule) AS n, "
    "row_number() OVER (PARTITION BY feature, rule ORDER BY customer_id, shown) AS rn FROM (SELECT customer_id, feature, rule, "
    "CAST(CAST(value AS DOUBLE) AS VARCHAR) AS shown FROM broken)) WHERE rn <= 3 GROUP BY feature, rule",
    "applicants", broken=_BROKEN))(lambda spark, sf: scoring.validation_summary(raw(spark, sf)))

register("project_contract", sql(f"SELECT customer_id, {', '.join(MODEL_INPUTS)} FROM cleaned", "cleaned"))(
    lambda spark, sf: scoring.project_contract(cleaned(spark, sf), ("customer_id",)))

register("schema_table", sql(
    " UNION ALL ".join(
        f"SELECT '{c.feature}' AS feature, '{c.kind}' AS kind, true AS nullable, "
        f"{'CAST(NULL AS DOUBLE)' if c.minimum is None else f'{c.minimum:g}e0'} AS minimum, "
        f"{'CAST(NULL AS DOUBLE)' if c.maximum is None else f'{c.maximum:g}e0'} AS maximum, "
        f"CAST(count({c.feature}) AS BIGINT) AS present FROM applicants" for c in CONTRACT), "applicants"))(
    lambda spark, sf: scoring.schema_table(spark).select("feature", "kind", "nullable", "minimum", "maximum").join(
        profiling.non_null_counts(raw(spark, sf).select(*MODEL_INPUTS)).selectExpr("column AS feature", "n AS present"),
        "feature"))
