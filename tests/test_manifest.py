from collections import Counter

import duckdb
import pytest

from lodestone import queries

ROWS = [(0, "a", "x"), (1, "a", "y"), (2, "a", "z"), (3, "b", "z"), (4, "b", "z"), (5, "b", "z"), (6, None, None), (7, None, "n"), (8, None, None), (None, "c", "c")]


def against_sql(spark, tmp_path, name):
    """Pages that share an url, with the same text or another, and nulls."""
    spark.createDataFrame(ROWS, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert Counter(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == Counter(con.sql(queries.ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["manifest_diff", "manifest_queue"])
def test_pages_that_share_an_url(spark, tmp_path, name):
    against_sql(spark, tmp_path, name)
