"""Composed jobs: the flagship report, file and model round trips, streams and defect injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.models import split_cleaned
from catalog.registry import ORACLES, cleaned, raw, register, round_doubles
from catalog.rows import _BROKEN, _CARD_SQL, _DECISION, _SCORED, _TIER
from catalog.sql import NUMERIC, r, sql
from catalog.tables import SPLIT_SQL
from underwright.operators import eda, injection, models, scoring
from underwright.operators.splits import stratified_split
from underwright.plans import batch_scoring, training
from underwright.plans.flagship import tier_summary
from underwright.plans.profile import eda_suite, quality_report
from underwright.session import materialise, scratch_path
from underwright.sources import files
from underwright.sources import scorecard as card
from underwright.sources.applicants import table
from underwright.sources.contract import APPLICANT_DDL
from underwright.streaming import scoring as streams

register("tier_summary", sql(
    "SELECT credit_tier, CASE WHEN p >= 0.64e0 THEN 'Approve' ELSE 'Reject' END AS decision, CAST(count(*) AS BIGINT) AS n, "
    "round(avg(p), 4) AS mean_p, round(1 - avg(creditworthy), 4) AS bad_rate FROM features JOIN scored USING (customer_id) "
    "GROUP BY 1, 2", "features", "scored"))(tier_summary)

# --- files ----------------------------------------------------------------------------------------


@register("scan_csv", sql("SELECT * FROM applicants", "applicants"))
def _scan_csv(spark, sf):
    path = scratch_path(spark, "csv")
    files.sink_csv(raw(spark, sf), path)
    return files.scan_csv(spark, path)


@register("sink_csv", sql("SELECT * FROM cleaned", "cleaned"))
def _sink_csv(spark, sf):
    path = scratch_path(spark, "csv")
    files.sink_csv(cleaned(spark, sf), path)
    return files.scan_csv(spark, path)


@register("sink_split", sql("SELECT customer_id, creditworthy, split FROM s WHERE split = 'validation'", "cleaned", s=SPLIT_SQL.format(val=0.2)))
def _sink_split(spark, sf):
    path = scratch_path(spark, "split")
    files.sink_split(stratified_split(cleaned(spark, sf).select("customer_id", "creditworthy")), path)
    return spark.read.schema("customer_id string, creditworthy int, split string").parquet(path).filter("split = 'validation'")


_RANKED = ("SELECT feature, row_number() OVER (ORDER BY abs(r) DESC, feature) - 1 AS position "
           "FROM c")
_CORRELATIONS = " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'corr({c}, creditworthy)')} AS r FROM cleaned" for c in NUMERIC)


def _artifact(spark, sf):
    """The whole ranked list, written and read."""
    best = round_doubles(eda.target_correlation(cleaned(spark, sf))).orderBy(F.expr("abs(r)").desc(), "feature")
    path = scratch_path(spark, "selected")
    files.write_json(spark, [row["feature"] for row in best.collect()], path)
    return spark.createDataFrame(list(enumerate(files.read_json(spark, path))), "position int, feature string")


# the first ten places of the list, as the SQL asks; json_artifact_whole has all
register("json_artifact", sql(
    f"SELECT CAST(position AS INTEGER) AS position, feature FROM ({_RANKED}) WHERE position < 10", "cleaned", c=_CORRELATIONS))(
    lambda spark, sf: _artifact(spark, sf).filter("position < 10"))
register("json_artifact_whole", sql(
    f"SELECT CAST(position AS INTEGER) AS position, feature FROM ({_RANKED})", "cleaned", c=_CORRELATIONS))(_artifact)


# --- models on disk -------------------------------------------------------------------------------


def _saved(spark, sf):
    """(path, training result, validation rows) of a saved final model."""
    path = scratch_path(spark, "model")
    trained = training.train_final(raw(spark, sf), ["credit_score", "credit_utilization_ratio", "dti_ratio", "risk_index",
                                                    "num_late_payments_12m", "education"], path=path)
    rows = split_cleaned(spark, sf).filter("split = 'validation'").withColumn("label", F.col("creditworthy").cast("double"))
    return path, trained, rows


@register("load_model")
def _load_model(spark, sf):
    path, _, rows = _saved(spark, sf)
    model, metadata = files.load_model(spark, path)
    decisions, _ = batch_scoring.predict_batch(
        rows, batch_scoring.model_score(model), metadata["decision_threshold"], strict=False)
    return decisions


@register("save_model")
def _save_model(spark, sf):
    """Metadata row as read back from beside the saved stages."""
    path, _, _ = _saved(spark, sf)
    _, metadata = files.load_model(spark, path)
    rows = [(metadata["model_type"], metadata["decision_threshold"], metadata["n_features"], ",".join(metadata["features"]))]
    return spark.createDataFrame(rows, "model_type string, decision_threshold double, n_features int, features string")


@register("reload_parity", sql(
    "SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS unmatched, 0e0 AS max_difference, true AS equal FROM s WHERE split = 'validation'",
    "cleaned", s=SPLIT_SQL.format(val=0.2)))
def _reload_parity(spark, sf):
    path, trained, rows = _saved(spark, sf)
    model, _ = files.load_model(spark, path)
    return files.reload_parity(models.positive_scores(trained.model.transform(rows)), models.positive_scores(model.transform(rows)))


@register("model_metadata")
def _model_metadata(spark, sf):
    _, trained, _ = _saved(spark, sf)
    return trained.metadata.selectExpr("artifact_version", "model_type", "decision_threshold", "n_features", "to_json(metrics) AS metrics")


# --- batch scoring --------------------------------------------------------------------------------

_RAW_P = _CARD_SQL.replace("SELECT customer_id, creditworthy", "SELECT row_seq, customer_id, loan_purpose").replace("FROM dedup", "FROM applicants")
_EXACT_P = "1e0 / (1e0 + exp(-(0.5e0 + 0.006e0 * (score - 600e0) - 2e0 * (util - 0.5e0) + 4e0 * (pc - 0.9e0) - 1e0 * (dti - 0.2e0))))"
_VALID = {
    "broken": _BROKEN, "card": _RAW_P,
    "ok": f"SELECT row_seq, customer_id, {_EXACT_P} AS p FROM card WHERE row_seq NOT IN (SELECT row_seq FROM broken)",
    "decided": f"SELECT row_seq, customer_id, round(p, 4) AS p_creditworthy, round(1 - p, 4) AS p_default, {_DECISION} AS decision, "
               f"{_TIER} AS risk_tier FROM ok",
}
_KEEP = ("row_seq", "customer_id")
register("predict_batch", sql("SELECT * FROM decided", "applicants", **_VALID))(
    lambda spark, sf: batch_scoring.predict_batch(raw(spark, sf), batch_scoring.card_score, strict=False, keep=_KEEP)[0])
register("rejected_rows", sql(
    "SELECT row_seq, customer_id, CAST(count(*) AS INTEGER) AS broken_rules FROM (SELECT DISTINCT * FROM broken) GROUP BY 1, 2", "applicants", broken=_BROKEN))(
    lambda spark, sf: batch_scoring.predict_batch(raw(spark, sf).dropDuplicates(), batch_scoring.card_score, strict=False)[1].selectExpr(
        "row_seq", "customer_id", "size(violations) AS broken_rules"))


@register("csv_batch_score", sql("SELECT * EXCLUDE (row_seq) FROM decided", "applicants", **_VALID))
def _csv_batch_score(spark, sf):
    source, target = scratch_path(spark, "in"), scratch_path(spark, "out")
    files.sink_csv(raw(spark, sf), source)
    batch_scoring.csv_batch_score(spark, source, target, batch_scoring.card_score, rejects=scratch_path(spark, "rejects"))
    return files.scan_csv(spark, target, "customer_id string, p_creditworthy double, p_default double, decision string, risk_tier string")


@register("csv_rejects", sql(
    "SELECT row_seq, customer_id, CAST(count(*) AS INTEGER) AS broken_rules FROM (SELECT DISTINCT * FROM broken) GROUP BY 1, 2", "applicants", broken=_BROKEN))
def _csv_rejects(spark, sf):
    source, target, rejects = (scratch_path(spark, k) for k in ("in", "out", "rejects"))
    rows = raw(spark, sf).dropDuplicates()
    files.sink_csv(rows, source)
    batch_scoring.csv_batch_score(spark, source, target, batch_scoring.card_score, rejects=rejects)
    broken = files.scan_csv(spark, rejects, f"{files.text_ddl(rows._jdf.schema().toDDL())}, violations string")
    return broken.selectExpr("CAST(row_seq AS BIGINT) AS row_seq", "customer_id", "size(split(violations, '; ')) AS broken_rules")


# --- profiles -------------------------------------------------------------------------------------


def _sizes(spark, tables):
    """Rows of every table of a report."""
    out = None
    for name, df in tables.items():
        part = df.selectExpr(f"'{name}' AS report", "count(*) AS n")
        out = part if out is None else out.unionByName(part)
    return out


register("eda_suite")(lambda spark, sf: _sizes(spark, eda_suite(raw(spark, sf))))
register("quality_report")(lambda spark, sf: _sizes(spark, quality_report(materialise(raw(spark, sf), "raw"))))

#: Tables of the quality report: the query whose SQL gives the table, its text columns, its numbers.
_REPORT = {
    "overview": ("overview", (), ("n_rows", "n_columns", "duplicate_rows")),
    "columns": ("column_profile", ("column", "dtype"), ("non_null", "missing", "missing_pct", "distinct_values")),
    "missing": ("missing_report", ("column",), ("missing", "missing_pct")),
    "duplicates": ("duplicate_report", (), ("duplicate_rows", "duplicate_ids")),
    "categories": ("categorical_topn", ("column", "value"), ("n", "rank")),
    "numbers": ("numeric_describe", ("column",), ("n", "mean", "std", "min", "max", "q25", "q50", "q75")),
    "flags": ("dq_flags", ("flag",), ("n",)),
}


def _report_cells_sql():
    """One row per number of the report: table, the row's texts, measure and value."""
    parts = []
    for part, (query, texts, numbers) in _REPORT.items():
        key = "concat_ws('|', " + ", ".join(f'"{c}"' for c in texts) + ")" if texts else "''"
        parts += [f"SELECT '{part}' AS part, {key} AS key, '{c}' AS measure, round(CAST(\"{c}\" AS DOUBLE), 4) + 0e0 AS value FROM ({ORACLES[query]})" for c in numbers]
    return " UNION ALL ".join(parts)


def _report_cells(spark, sf):
    out = None
    for part, table_ in quality_report(materialise(raw(spark, sf), "raw")).items():
        _, texts, numbers = _REPORT[part]
        key = f"concat_ws('|', {', '.join(f'`{c}`' for c in texts)})" if texts else "''"
        cells = ", ".join(f"named_struct('measure', '{c}', 'value', round(CAST(`{c}` AS DOUBLE), 4) + 0D)" for c in numbers)
        rows = table_.selectExpr(f"'{part}' AS part", f"{key} AS key", f"inline(array({cells}))")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Every number of the report, against the SQL of its tables.
register("quality_report_cells", _report_cells_sql())(_report_cells)

# --- streams --------------------------------------------------------------------------------------

_STREAM_DDL = f"{APPLICANT_DDL}, ts timestamp"
_TS = "timestamp_seconds(1704067200 + CAST(substring(customer_id, 4, 7) AS BIGINT) * 60) AS ts"


def _applicant_files(spark, sf):
    """Applicants with a request time as a folder of files."""
    path = scratch_path(spark, "feed")
    raw(spark, sf).selectExpr("*", _TS).repartition(4, "customer_id").write.parquet(path)
    return path


@register("score_stream", sql("SELECT * FROM decided", "applicants", **_VALID))
def _score_stream(spark, sf):
    path, decisions, rejects, checkpoint = (_applicant_files(spark, sf), *(scratch_path(spark, k) for k in ("dec", "rej", "chk")))
    stream = streams.applicant_stream(spark, path, _STREAM_DDL, 2)
    streams.score_stream(stream, batch_scoring.card_score, decisions, rejects, checkpoint, keep=_KEEP).awaitTermination()
    return spark.read.parquet(decisions).drop("batch")


@register("stream_dedup", sql("SELECT DISTINCT customer_id FROM applicants", "applicants"))
def _stream_dedup(spark, sf):
    path, out, checkpoint = _applicant_files(spark, sf), scratch_path(spark, "out"), scratch_path(spark, "chk")
    stream = streams.applicant_stream(spark, path, _STREAM_DDL)
    kept = streams.stream_dedup(stream, "ts", "1 hour").select("customer_id")
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema("customer_id string").parquet(out)


def _decisions(spark, sf):
    """Decision per event user: the customer of the same number answers."""
    decided = scoring.score_applicants(card.scorecard_inputs(raw(spark, sf)), card.probability(digits=None))
    return decided.selectExpr("CAST(substring(customer_id, 4, 7) AS BIGINT) AS user_id", "decision")


_REQUESTS = ("SELECT e.ts, d.decision FROM events e JOIN (SELECT CAST(substring(customer_id, 4, 7) AS BIGINT) AS user_id, decision FROM "
             f"({_SCORED})) d ON d.user_id = e.user_id")
_HOURS = ("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS n, "
          "CAST(count(CASE WHEN decision = 'Approve' THEN 1 END) AS BIGINT) AS approved, CAST(count(CASE WHEN decision = 'Reject' THEN 1 END) AS "
          "BIGINT) AS rejected, round(count(CASE WHEN decision = 'Approve' THEN 1 END) * 1e0 / count(*), 4) AS approval_rate FROM req {where} GROUP BY 1")


def _hours(df):
    return df.selectExpr("date_format(window_start, 'yyyy-MM-dd HH:mm:ss') AS window_start", "n", "approved", "rejected", "approval_rate")


@register("decision_monitor", sql(_HOURS.format(where=""), "scored_raw", req=_REQUESTS))
def _decision_monitor(spark, sf):
    events = table(spark, sf, "events").selectExpr("CAST(ts AS timestamp) AS ts", "user_id")
    return _hours(streams.decision_monitor(events.join(_decisions(spark, sf), "user_id")))


@register("decision_monitor_stream", sql(_HOURS.format(
    where="WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM req) - INTERVAL 10 MINUTE"), "scored_raw", req=_REQUESTS))
def _decision_monitor_stream(spark, sf):
    """Closed windows only: the watermark trails the newest request by ten minutes."""
    feed, out, checkpoint = (scratch_path(spark, k) for k in ("feed", "out", "chk"))
    table(spark, sf, "events").selectExpr("CAST(ts AS timestamp) AS ts", "user_id").write.parquet(feed)
    decisions = materialise(_decisions(spark, sf), "decisions")
    requests = spark.readStream.schema("ts timestamp, user_id bigint").parquet(feed).join(decisions, "user_id")
    monitor = streams.decision_monitor(requests, delay="10 minutes")
    monitor.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start().awaitTermination()
    return _hours(spark.read.parquet(out))


# --- defects --------------------------------------------------------------------------------------


def _hash(*parts: str) -> str:
    return f"CAST(concat('0x', substring(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT) / 4294967296e0"


register("inject_missing", sql("SELECT customer_id, " + ", ".join(
    f"CASE WHEN {_hash('customer_id', repr(c), repr('42'))} < {share}e0 THEN NULL ELSE {c} END AS {c}"
    for c, share in injection.MISSING_SHARES.items()) + " FROM cleaned", "cleaned"))(
    lambda spark, sf: injection.inject_missing(cleaned(spark, sf)).select("customer_id", *injection.MISSING_SHARES))
register("inject_outliers", sql(
    "SELECT customer_id, CASE WHEN rk <= greatest(1, CAST(floor((SELECT count(*) FROM cleaned) * 0.004e0) AS BIGINT)) THEN monthly_income * 8 "
    "ELSE monthly_income END AS monthly_income FROM (SELECT *, CASE WHEN monthly_income IS NOT NULL THEN row_number() OVER (PARTITION BY "
    "monthly_income IS NULL ORDER BY md5(concat(customer_id, '|42|outlier'))) END AS rk FROM cleaned)", "cleaned"))(
    lambda spark, sf: injection.inject_outliers(materialise(cleaned(spark, sf).select("customer_id", "monthly_income"), "income")))
register("inject_duplicates", sql(
    "SELECT customer_id, loan_amount FROM cleaned UNION ALL SELECT customer_id, loan_amount FROM (SELECT *, row_number() OVER (ORDER BY "
    "md5(concat(customer_id, '|42|duplicate'))) AS rk FROM cleaned) WHERE rk <= greatest(1, CAST(floor((SELECT count(*) FROM cleaned) * 0.008e0) "
    "AS BIGINT))", "cleaned"))(
    lambda spark, sf: injection.inject_duplicates(materialise(cleaned(spark, sf).select("customer_id", "loan_amount"), "loans")))


@register("calibrate_intercept", sql(
    "SELECT round((lo + hi) / 2, 6) AS intercept FROM bis ORDER BY step DESC LIMIT 1", "cleaned",
    **{"z": "SELECT (credit_score - 600) / 100e0 AS z FROM cleaned WHERE credit_score IS NOT NULL",
       "zc": "SELECT z, count(*) AS n FROM z GROUP BY 1"}).replace("WITH ", "WITH RECURSIVE ", 1).replace(
    " SELECT round((lo + hi) / 2, 6)",
    ", bis AS (SELECT 0 AS step, -10e0 AS lo, 10e0 AS hi UNION ALL SELECT step + 1, CASE WHEN m < 0.8e0 THEN mid ELSE lo END, CASE WHEN m < 0.8e0 "
    "THEN hi ELSE mid END FROM (SELECT step, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) / 2) AS mid, "
    "sum(n / (1e0 + exp(-(z + (lo + hi) / 2)))) / sum(n) AS m FROM bis, zc WHERE step < 60 GROUP BY step)) SELECT round((lo + hi) / 2, 6)", 1))
def _calibrate_intercept(spark, sf):
    shift = injection.calibrate_intercept(cleaned(spark, sf), "(credit_score - 600) / 100D", 0.8)
    return spark.createDataFrame([(round(shift, 6),)], "intercept double")
