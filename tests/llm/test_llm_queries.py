"""The registered queries: SQL forms on a small table, and the pipeline against brute force."""

import duckdb
import pytest

import corpus_pipeline
from meshfold.llm import queries, text_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, SF)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    group = {i: i for i, _ in rows}
    for a in range(len(rows)):
        for b in range(a):
            if abs(len(rows[a][1]) - len(rows[b][1])) < 0.3 * len(rows[a][1]) and text_dedup.similar(rows[a][1], rows[b][1]) >= 0.8:
                x, y = sorted((group[rows[a][0]], group[rows[b][0]]))
                group = {k: x if v == y else v for k, v in group.items()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group.values()))
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} <= set(group.values())
