"""Every registered query against its SQL oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from echoframe.plans import registry
from tools.check_oracle import TABLES, rows

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(registry.PLANS) - set(registry.ORACLES) == {"u5_fit_ridge"}


def test_entry_is_lazy_and_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["doc_id", "n_raw_tokens", "detokenized_text_truncated"]
    assert frame.limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf, db, name):
    frame = QUERIES[name](spark, sf)
    got = rows(frame.columns, frame.collect())
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert got == rows(names, cursor.fetchall())
