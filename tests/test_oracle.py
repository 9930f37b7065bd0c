"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from ringspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want)


SEARCHES = sorted(n for n in set(catalog.QUERIES) - set(catalog.ORACLE_SQL) if n.startswith("search_"))


def test_only_these_have_no_sql():
    assert sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - set(SEARCHES)) == ["depth_first_search", "frontier_search", "layout_step_cells", "training_gradient"]


@pytest.mark.parametrize("name", SEARCHES)
def test_search_has_rows(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert len(rows) == 8 and not any(r["error"] and r["error"] != "out of steps" for r in rows)
    # a search that ran out of steps made all of them; one that ended in success has no error
    assert all(r["steps"] == 10_000 if r["error"] else r["steps"] <= 10_000 for r in rows)
    assert all(r["final_girth"] == r["g"] for r in rows if r["success"])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
