"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from suffixloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLES])
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, SF)
    expected = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_strategies_agree_on_documents(spark):
    rows = [sorted(map(tuple, catalogue.QUERIES[n](spark, SF).collect())) for n in ("bwt_documents", "bwt_documents_parse")]
    assert rows[0] == rows[1] and rows[0]
