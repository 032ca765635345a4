"""Every query with SQL against DuckDB on the smallest tables; the operators of sondage.llm are tested on their own."""

import os

import duckdb
import pytest

from sondage.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 8)
    return v.replace(tzinfo=None) if hasattr(v, "replace") and hasattr(v, "hour") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE])
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(catalog.ORACLE[name])
    theirs = [x[0] for x in cursor.description]
    assert sorted(theirs) == columns
    rows = [tuple(plain(r[theirs.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert mine == sorted(rows, key=repr)


def test_every_query_without_sql_runs(spark):
    for name, q in catalog.QUERIES.items():
        if name not in catalog.ORACLE:
            assert q(spark, SF).count() >= 0
