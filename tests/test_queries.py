"""Every graph query against its DuckDB form."""

import duckdb
import pytest

from meshfold.plans import graph_queries, graph_sql

SF = "/root/testdata/sf0.001"


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(graph_sql.SQL))
def test_against_sql(spark, duck, name):
    got = graph_queries.QUERIES[name](spark, SF)
    want = duck.execute(graph_sql.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), names)


def test_every_query_has_sql_but_training():
    assert set(graph_queries.QUERIES) - set(graph_sql.SQL) == {"train_run"}
