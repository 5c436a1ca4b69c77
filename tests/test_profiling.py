"""Profile, quality flags and default rates on odd values and empty tables."""

from __future__ import annotations

import math

import numpy as np

from underwright.operators import eda, profiling, transforms

ROWS = """
    SELECT * FROM VALUES
        (1, 0.0D, 'a', TIMESTAMP '2024-01-01 00:00:00', X'00', array(1, 2), true, 'x'),
        (1, -0.0D, 'a', TIMESTAMP '2024-01-01 00:00:00', X'00', array(1, 2), true, 'y'),
        (2, double('NaN'), '', TIMESTAMP '2024-01-01 00:00:00.000001', X'0000', array(1, NULL), false, NULL),
        (2, double('NaN'), '', TIMESTAMP '2024-01-01 00:00:00.000001', X'0000', array(1, NULL), false, NULL),
        (NULL, double('Infinity'), NULL, NULL, NULL, NULL, NULL, NULL),
        (NULL, 1e-300D, 'A', NULL, X'', array(), NULL, 'null')
    AS t(customer_id, `odd name`, word, at, bytes, list, flag, value)"""


def test_profile_counts_like_count_distinct(spark):
    df = spark.sql(ROWS)
    found = {r["column"]: r for r in profiling.column_profile(df).collect()}
    assert set(found) == set(df.columns)
    for c, kind in df.dtypes:
        n, distinct = df.selectExpr(f"count(`{c}`)", f"count(DISTINCT `{c}`)").first()
        r = found[c]
        assert (r["dtype"], r["non_null"], r["missing"], r["distinct_values"]) == (kind, n, 6 - n, distinct), c
        assert math.isclose(r["missing_pct"], round((6 - n) * 100 / 6, 2))
    rough = {r["column"]: r["non_null"] for r in profiling.column_profile(df, approximate=True).collect()}
    assert rough == {c: r["non_null"] for c, r in found.items()}


def test_profile_of_an_empty_table(spark):
    rows = profiling.column_profile(spark.sql(ROWS).limit(0)).collect()
    assert len(rows) == 8 and all((r["non_null"], r["missing"], r["missing_pct"], r["distinct_values"]) == (0, 0, None, 0) for r in rows)


def test_flags_in_one_read(spark):
    df = spark.sql(ROWS)
    # rows 3 and 4 are equal; the ids 1, 2 and null have one surplus row each, of which one is a copy
    assert {r["flag"]: r["n"] for r in profiling.dq_flags(df.drop("list")).collect()} == {
        "missing:customer_id": 2, "missing:word": 1, "missing:at": 2, "missing:bytes": 1, "missing:flag": 2, "missing:value": 3,
        "duplicate_rows": 1, "duplicate_ids": 3}
    whole = spark.range(5).selectExpr("id AS customer_id", "'x' AS _id", "1 AS n")
    for table in (whole, whole.limit(0)):
        assert [tuple(r) for r in profiling.dq_flags(table).collect()] == [("none", 0)]


def test_default_rates_of_an_empty_table_and_of_null_classes(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 0), ('b', 0), (NULL, 1), ('b', NULL) AS t(kind, creditworthy)")
    found = {r["value"]: (r["n"], r["default_rate"], r["overall_rate"]) for r in eda.default_rate_by(df).collect()}
    assert found == {"a": (2, 0.5, 0.5), "b": (1, 1.0, 0.5)}
    assert eda.default_rate_by(df.limit(0)).count() == 0


def test_density_adds_up_in_tasks(spark):
    rows = [(k % 2, float(k % 7) if k % 2 else 3.0, None if k % 3 else float(k)) for k in range(300)] + [(1, None, None), (None, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "creditworthy int, `odd name` double, other double").repartition(5)
    found = eda.class_density(df, ["odd name", "other"], points=11).collect()
    for label, column, at in ((1, "odd name", 1), (0, "other", 2), (1, "other", 2)):
        own = np.array([r[at] for r in rows if r[0] == label and r[at] is not None])
        width = len(own) ** -0.2 * own.std(ddof=1)
        grid = np.linspace(own.min(), own.max(), 11)
        expected = np.exp(-0.5 * ((grid[:, None] - own) / width) ** 2).sum(axis=1) / (len(own) * width * math.sqrt(2 * math.pi))
        points = sorted((r["point"], r["x"], r["density"], r["median"]) for r in found if r["class"] == label and r["column"] == column)
        assert np.allclose([p[1:3] for p in points], np.column_stack((grid, expected))) and len(points) == 11
        assert points[0][3] == np.median(own)
    assert not [r for r in found if r["class"] == 0 and r["column"] == "odd name"]  # one value only
    assert eda.class_density(df.limit(0), ["other"]).count() == 0


def test_modes_of_columns_with_many_values(spark):
    df = spark.range(3 * transforms.MAX_CATEGORIES).selectExpr(
        "CAST(IF(id < 2, 7, id) AS STRING) AS many", "IF(id % 2 = 0, 'b', 'a') AS tie", "CAST(NULL AS STRING) AS none")
    assert transforms.fit_modes(df, ["many", "tie", "none"]) == {"many": "7", "tie": "a", "none": None}
