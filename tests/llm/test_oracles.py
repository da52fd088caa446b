"""The queries against their SQL, on the smallest tables and on rows with nulls."""

import duckdb
import pytest

from verdigris.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    lines = "a b c\n\na b c\n" * 30
    documents = [(1, None), (2, ""), (3, "one two"), (4, "One two"), (5, lines), (6, lines + "d"), (7, "§ é # * word " * 60), (8, " \t\n")]
    spark.createDataFrame(documents, "doc_id bigint, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    talks = [(1, 1, "assistant", "50% <s> é"), (1, 0, "user", None), (2, 0, "system", "x"), (2, None, None, "y"), (3, 0, "user", "q")]
    spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(oracles.SQL))
@pytest.mark.parametrize("small", [True, False])
def test_sql(spark, tables, name, small):
    folder = tables if small else SF
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if small else ''}')")
    df = queries.QUERIES[name](spark, folder)
    cur = con.execute(oracles.SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=str)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want
