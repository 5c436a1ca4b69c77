"""Applicant table derived from the customer, orders, lineitem and events tables.

One pass per table: line items are aggregated to the order and orders to the customer, clicks to the event user, who answers
for ten customers, and the duplicate rows are produced by an array explode instead of reading the derived table three times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwright.sources.contract import COLUMN_NAMES

CUSTOMERS_PER_USER = 10

# Column layout of the source tables, declared so that no file is opened to infer it.
TABLE_DDL = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

LATE = "o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"
DEFAULTED = "o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AND o_totalprice > 400000"
IDLE = "(seg = 'HOUSEHOLD' AND ck % 3 = 0)"
UTILIZATION = "(((ck * 37) % 131) / 100D)"

# Definition of each applicant column on the joined customer row.
DEFINITIONS = {
    "row_seq": "CASE WHEN copy = 'other' THEN ck + 1000000000 ELSE ck END",
    "customer_id": "concat('CS-', lpad(CAST(ck AS STRING), 7, '0'))",
    "age": "CAST(16 + (ck * 7) % 55 AS DOUBLE)",
    "gender": "CASE WHEN ck % 20 < 11 THEN 'Male' ELSE 'Female' END",
    "marital_status": "CASE WHEN ck % 25 < 7 THEN 'Single' WHEN ck % 25 < 21 THEN 'Married' "
                      "WHEN ck % 25 < 24 THEN 'Divorced' ELSE 'Widowed' END",
    "dependents": "CAST((ck * 3) % 8 - 1 AS DOUBLE)",
    "education": "element_at(array('High School', 'Bachelor', 'Master', 'Doctorate'), CAST(nk % 4 + 1 AS INT))",
    "employment_status": f"CASE WHEN {IDLE} THEN 'Unemployed' WHEN seg = 'FURNITURE' THEN 'Self-Employed' ELSE 'Employed' END",
    "employment_years": f"CASE WHEN {IDLE} THEN NULL ELSE ((ck * 7) % 250) / 10D END",
    "monthly_income": "CASE WHEN ck % 100 = 9 THEN NULL WHEN ck % 250 = 4 THEN bal * 80 WHEN ck % 400 = 2 THEN 0D "
                      "ELSE bal * 10 END",
    "monthly_expenses": "round(avg_price / 10D, 0)",
    "savings_balance": "CASE WHEN ck % 33 != 5 THEN round(tot / 4D, 0) END",
    "total_assets": "tot",
    "monthly_debt_payment": "debt",
    "num_open_accounts": "CAST(n_orders AS DOUBLE)",
    "num_credit_inquiries_6m": "CAST(clicks AS DOUBLE)",
    "num_late_payments_12m": "CAST(late AS DOUBLE)",
    "num_previous_defaults": "CAST(dflt AS DOUBLE)",
    "months_since_last_delinquency": "CASE WHEN late + dflt > 0 "
                                     "THEN CAST((2001 - year(last_dlq)) * 12 + 8 - month(last_dlq) AS DOUBLE) END",
    "credit_utilization_ratio": f"CASE WHEN ck % 50 != 7 THEN {UTILIZATION} END",
    "credit_score": "CASE WHEN ck % 200 != 3 THEN round(300 + (bal + 1000) / 11000 * 600, 0) END",
    "interest_rate": "round(4 + ((ck * 53) % 97) / 4D, 2)",
    "loan_amount": "round(max_price, -3)",
    "loan_term_months": "CAST(CASE WHEN ck % 300 = 11 THEN 0 ELSE 12 * (1 + ck % 5) END AS DOUBLE)",
    "loan_purpose": "CASE WHEN copy = 'other' THEN 'Personal' ELSE element_at(array('Debt Consolidation', 'Home', 'Auto', "
                    "'Education', 'Personal', 'Business', 'Medical'), CAST(ck % 7 + 1 AS INT)) END",
    "creditworthy": f"CAST(CASE WHEN (bal + 1000) / 2200 - 3 * {UTILIZATION} - 0.8D * late - 1.5D * dflt "
                    "+ ((ck * 101) % 103) / 25D > 0D THEN 1 ELSE 0 END AS INT)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(TABLE_DDL[name]) if name in TABLE_DDL else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals, delinquency marks and monthly debt (a tenth of the average line price) per customer.

    Line items are reduced to a sum and a count per order first, so the join moves one row per order,
    orders are read once and one aggregation by customer serves all columns.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey AS o_orderkey")).agg(
        F.expr("sum(l_extendedprice) AS line_sum"), F.expr("count(l_extendedprice) AS line_n"))
    aggregates = {
        "n_orders": "count(*)",
        "tot": "round(sum(o_totalprice), 2)",
        "avg_price": "round(avg(o_totalprice), 2)",
        "max_price": "max(o_totalprice)",
        "late": f"count_if({LATE})",
        "dflt": f"count_if({DEFAULTED})",
        "last_dlq": f"max(CASE WHEN ({LATE}) OR ({DEFAULTED}) THEN o_orderdate END)",
        "debt": "round(sum(line_sum) / sum(line_n) / 10, 0)",
    }
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "ck").join(lines, "o_orderkey", "left")
    return orders.groupBy("ck").agg(*[F.expr(e).alias(c) for c, e in aggregates.items()])


def click_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large clicks per event user."""
    return (
        table(spark, sf_dir, "events")
        .filter("event_type = 'click' AND value > 100")
        .groupBy("user_id").agg(F.expr("count(*) AS clicks"))
    )


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw applicants, one row per customer plus exact and same-id duplicates."""
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS ck", "c_acctbal AS bal", "c_nationkey AS nk", "c_mktsegment AS seg",
        f"CAST(floor(c_custkey / {CUSTOMERS_PER_USER}) AS BIGINT) AS user_id")
    base = (
        customers.join(order_history(spark, sf_dir), "ck", "left")
        .join(click_history(spark, sf_dir), "user_id", "left")
        .fillna(0, ["n_orders", "late", "dflt", "clicks"])
    )
    copies = ("explode(concat(array('plain'), IF(ck % 125 = 0, array('same'), array()), "
              "IF(ck % 250 = 1, array('other'), array()))) AS copy")
    return base.selectExpr("*", copies).selectExpr(*[f"{DEFINITIONS[c]} AS {c}" for c in COLUMN_NAMES])
