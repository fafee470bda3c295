"""Every registered query against its SQL counterpart on the smallest tables."""

import math

import duckdb
import pytest

from suite import load

REGISTRY = load()
DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, sql, name):
    df = REGISTRY.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in REGISTRY.ORACLES:
        rel = sql.sql(REGISTRY.ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(rel.fetchall(), rel.columns)


def test_every_sql_belongs_to_a_query():
    assert set(REGISTRY.ORACLES) <= set(REGISTRY.QUERIES)
    assert set(REGISTRY.QUERIES) - set(REGISTRY.ORACLES) == {"train_score"}
