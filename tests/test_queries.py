"""Every query with SQL gives what the SQL gives in an independent engine."""

import duckdb
import pytest

from kernelweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    key = lambda x: round(x, 9) + 0.0 if isinstance(x, float) else x
    return sorted([tuple(key(r[k]) for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    want = got.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert len(want) > 0
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
