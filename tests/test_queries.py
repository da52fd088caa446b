"""Every registered plant query against its SQL."""

import duckdb
import pytest

from verdigris import discipline_queries, model_queries, plant_queries

SF = "/root/testdata/sf0.001"
QUERIES = {**plant_queries.QUERIES, **model_queries.QUERIES, **discipline_queries.QUERIES}
SQL = {**plant_queries.SQL, **model_queries.SQL, **discipline_queries.SQL}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    if name not in SQL:
        assert got
        return
    cur = db.execute(SQL[name])
    want = _rows(cur.fetchall(), [c[0] for c in cur.description])
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert got == want
