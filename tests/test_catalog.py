import duckdb
import pytest

import __spark_entry__
from lodestrata import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted(repr(tuple(fix(v) for v in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    found = found.select(columns).collect()
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(found) == plain(expected)


def test_entry(spark):
    rows = catalog.entry(spark, SF_DIR).collect()
    assert rows and all(r["group_aware_crossings"] == 0 for r in rows)


def test_contract():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and set(catalog.queries()) <= names
