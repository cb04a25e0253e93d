"""Registered queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from tidegrid import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    found = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    wanted = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        assert all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) and y is not None else x == y for x, y in zip(a, b))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 30
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
