"""Queries on feature selection. The transformed training matrix is the input, as in the training chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fitted import OUTPUT_NAMES, PREPROCESSED, split_rows, train_of
from catalog.registry import cleaned, register, round_doubles, stored
from catalog.sql import NUMERIC, r, sql
from underwright.functions.scalars import unpivot
from underwright.operators import selection as sel
from underwright.operators import transforms as tr
from underwright.session import materialise

_NAMES = [c.strip('"') for c in OUTPUT_NAMES]
_NUM = [c for c in _NAMES if c in (*tr.MEDIAN_COLUMNS, *tr.FLAGS, tr.MONTHS)]
_TR = {**PREPROCESSED,
       "tm": "SELECT m.*, f.creditworthy FROM matrix m JOIN features f USING (customer_id) WHERE m.split = 'train'"}


def matrix_rows(spark, sf):
    """Transformed training rows with id and target, written once; and the column names."""
    rows = split_rows(spark, sf)
    state = tr.fit_preprocess(train_of(rows))
    table = materialise(tr.apply_preprocess(train_of(rows), state, ("customer_id", "creditworthy")), "matrix")
    return table, list(tr.output_columns(state))


_ALL_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({x}, {y}) AS r FROM tm"
    for i, (a, x) in enumerate(zip(_NAMES, OUTPUT_NAMES)) for b, y in list(zip(_NAMES, OUTPUT_NAMES))[i + 1:])
_NUM_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM tm" for i, a in enumerate(_NUM) for b in _NUM[i + 1:])


@register("corr_pairs", sql(
    "SELECT a, b, round(abs(r), 3) AS r, a AS drop_candidate FROM pr WHERE abs(r) > 0.9e0", "features", **_TR, pr=_NUM_PAIRS))
def _corr_pairs(spark, sf):
    table, _ = matrix_rows(spark, sf)
    return sel.corr_pairs(table, _NUM)


_VARIANCE = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, var_pop({c}) AS v FROM tm" for n, c in zip(_NAMES, OUTPUT_NAMES))


@register("variance_filter", sql(
    f"SELECT feature, {r('v')} AS variance, v < 0.01e0 AS low FROM va", "features", **_TR, va=_VARIANCE))
def _variance_filter(spark, sf):
    return round_doubles(sel.variance_filter(*matrix_rows(spark, sf)))


register("vif", sql(
    f"SELECT feature, {r('1 / (1 - c * c)', 4)} AS vif FROM (SELECT unnest(['credit_score', 'interest_rate']) AS feature, "
    "corr(credit_score, interest_rate) AS c FROM tm)", "features", **_TR))(
    lambda spark, sf: round_doubles(sel.vif(matrix_rows(spark, sf)[0], ["credit_score", "interest_rate"]), 4))


@register("vif_all_columns")
def _vif_all(spark, sf):
    return round_doubles(sel.vif(*matrix_rows(spark, sf)), 4)


_MI_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, creditworthy AS y, {c} AS v FROM cleaned WHERE {c} IS NOT NULL" for c in NUMERIC)
_MI = {
    "vals": _MI_VALUES,
    "edges": "SELECT feature, [" + ", ".join(f"quantile_cont(v, {k / 20})" for k in range(1, 20)) + "] AS e FROM vals GROUP BY 1",
    "cells": "SELECT feature, len(list_filter(e, lambda x: x < v)) AS bin, y, count(*) * 1e0 AS n FROM vals JOIN edges USING (feature) GROUP BY 1, 2, 3",
    "mi": "SELECT feature, sum(n / t * ln(n * t / (nb * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) "
          "OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM cells) GROUP BY 1",
}
register("mutual_information", sql(f"SELECT feature, {r('mi')} AS mi FROM mi", "cleaned", **_MI))(
    lambda spark, sf: round_doubles(sel.mutual_information(stored(spark, sf), NUMERIC)))


@register("rfe")
def _rfe(spark, sf):
    table, names = matrix_rows(spark, sf)
    return spark.createDataFrame([(c,) for c in sel.rfe(table, names, 25)], "feature string")


@register("permutation_select")
def _permutation_select(spark, sf):
    table, names = matrix_rows(spark, sf)
    return sel.permutation_select(table, names)


# --- consensus of ranked lists that SQL can derive too --------------------------------------------


def _lists(spark, sf):
    """Three rankings of the cleaned numeric columns: mutual information, correlation, class mean gap."""
    rows = materialise(cleaned(spark, sf).select("creditworthy", *NUMERIC), "numeric")
    mi = materialise(round_doubles(sel.mutual_information(rows, NUMERIC)), "mi")
    stats = unpivot(rows, ["creditworthy"], list(NUMERIC), "double", "feature").groupBy("feature").agg(
        F.expr("round(abs(corr(value, creditworthy)), 6) AS c"),
        F.expr("round(abs(avg(IF(creditworthy = 1, value, NULL)) - avg(IF(creditworthy = 0, value, NULL))) / stddev_pop(value), 6) AS g"))
    stats = materialise(stats, "stats")
    lists = (sel.top_features(mi, "mi", 8, "mi"), sel.top_features(stats, "c", 8, "corr"), sel.top_features(stats, "g", 8, "gap"))
    return rows, mi, stats, lists


def _top(table: str, column: str, method: str) -> str:
    return (f"SELECT '{method}' AS method, feature FROM (SELECT *, row_number() OVER (ORDER BY {column} DESC, feature) AS k FROM {table}) "
            "WHERE k <= 8")


_LISTS = {
    **_MI,
    "mir": "SELECT feature, round(mi, 6) AS mi FROM mi",
    "stats": "SELECT feature, round(abs(corr(v, y)), 6) AS c, round(abs(avg(CASE WHEN y = 1 THEN v END) - avg(CASE WHEN y = 0 THEN v END)) "
             "/ stddev_pop(v), 6) AS g FROM vals GROUP BY 1",
    "lists": f"{_top('mir', 'mi', 'mi')} UNION ALL {_top('stats', 'c', 'corr')} UNION ALL {_top('stats', 'g', 'gap')}",
    "votes": "SELECT feature, CAST(count(DISTINCT method) AS BIGINT) AS votes FROM lists GROUP BY 1",
    "consensus": "SELECT * FROM votes WHERE votes >= 2",
    "prs": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM cleaned" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]),
    "pruned": "SELECT DISTINCT CASE WHEN coalesce(y.mi, 0) < coalesce(x.mi, 0) THEN b ELSE a END AS feature FROM prs LEFT JOIN mir x ON "
              "x.feature = a LEFT JOIN mir y ON y.feature = b WHERE abs(r) > 0.5e0 AND a IN (SELECT feature FROM consensus) AND b IN "
              "(SELECT feature FROM consensus)",
    "low": " UNION ALL ".join(f"SELECT '{c}' AS feature FROM cleaned HAVING var_pop({c}) < 0.01e0" for c in NUMERIC),
    "final": "SELECT feature FROM consensus WHERE feature NOT IN (SELECT feature FROM pruned) AND feature NOT IN (SELECT feature FROM low)",
}


@register("vote_consensus", sql("SELECT * FROM consensus", "cleaned", **_LISTS))
def _vote_consensus(spark, sf):
    return sel.vote_consensus(*_lists(spark, sf)[3])


def _pruned(rows, mi, lists):
    consensus = sel.vote_consensus(*lists)
    return consensus, sel.redundancy_prune(sel.corr_pairs(rows, NUMERIC, 0.5), consensus, mi)


@register("redundancy_prune", sql("SELECT * FROM pruned", "cleaned", **_LISTS))
def _redundancy_prune(spark, sf):
    rows, mi, _, lists = _lists(spark, sf)
    return _pruned(rows, mi, lists)[1]


@register("final_selected", sql("SELECT * FROM final", "cleaned", **_LISTS))
def _final_selected(spark, sf):
    rows, mi, _, lists = _lists(spark, sf)
    consensus, pruned = _pruned(rows, mi, lists)
    return sel.final_selected(consensus, pruned, sel.variance_filter(rows, NUMERIC))


@register("importance_align", sql(
    "SELECT s.feature, coalesce(m.mi, 0e0) AS mutual_info, s.c AS corr, coalesce(v.votes, 0) AS votes FROM stats s LEFT JOIN mir m USING "
    "(feature) LEFT JOIN votes v USING (feature)", "cleaned", **_LISTS))
def _importance_align(spark, sf):
    _, mi, stats, lists = _lists(spark, sf)
    return sel.importance_align(stats, {
        "mutual_info": (mi, "mi", 0.0), "corr": (stats, "c", 0.0), "votes": (sel.vote_consensus(*lists, votes=1), "votes", 0)})


@register("selection_table", sql(
    "SELECT s.feature, round(coalesce(m.mi, 0e0), 4) AS mutual_info, round(s.c, 4) AS perm_imp, s.feature IN (SELECT feature FROM lists WHERE "
    "method = 'gap') AS rfe_kept, coalesce(v.votes, 0) AS votes, round(s.g, 1) AS vif, s.g > 10 AS high_vif, s.feature IN (SELECT feature FROM "
    "final) AS final_keep FROM stats s LEFT JOIN mir m USING (feature) LEFT JOIN votes v USING (feature)", "cleaned", **_LISTS))
def _selection_table(spark, sf):
    rows, mi, stats, lists = _lists(spark, sf)
    consensus, pruned = _pruned(rows, mi, lists)
    final = sel.final_selected(consensus, pruned, sel.variance_filter(rows, NUMERIC))
    return sel.selection_table(stats, mi, stats.withColumnRenamed("c", "importance"), lists[2],
                               sel.vote_consensus(*lists, votes=1), stats.withColumnRenamed("g", "vif"), final)


@register("run_selection")
def _run_selection(spark, sf):
    table, names = matrix_rows(spark, sf)
    return sel.run_selection(table, names)["table"]
