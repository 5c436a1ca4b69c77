"""Cases that the given tables lack, for queries with SQL; ``test_llm`` compares the others."""

from __future__ import annotations

import duckdb
from compare import difference

from underwright.llm import queries


def test_sql_counts_revisits_and_empty_pages(spark, tmp_path):
    """The given pages have no equal payloads, so equal, empty and null ones are checked here."""
    rows = [(5, "u5", "<p>same</p>"), (2, "u2", "<p>same</p>"), (9, "u9", None), (7, None, ""), (1, "u1", "für"), (3, "u3", "<p>same</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = queries.op9_warc(spark, str(tmp_path))
    assert difference(found, con, queries.all_oracles()["op9_warc"]) is None
    assert {r["page_id"]: r["refers_to"] for r in found.collect()} == {5: 2, 2: None, 9: 7, 7: None, 1: None, 3: 2}
