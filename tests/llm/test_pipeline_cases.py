"""The pipeline on hard tables, the near-duplicate stage against brute force on a whole table, and its column names."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from meshfold.llm import common, text_dedup
from meshfold.llm.simhash import shingle_hashes

BASE = "the quick brown fox jumps over the lazy dog while a second fox sleeps near the old river bank and dreams of winter rain upon a silent green hill"


def test_recall_on_a_whole_table(spark):
    """Every pair of texts of J >= 0.8 that shares a shingle which at most 300 texts have, on sf0.1."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [np.unique(shingle_hashes(r.text, 5)) for r in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for h in s.tolist():
            where[h].append(i)
    joint = Counter(p for at in where.values() if 1 < len(at) <= 300 for p in combinations(at, 2))
    near = [(i, j) for (i, j), n in joint.items() if n >= 0.2 * max(len(sets[i]), len(sets[j])) and (x := len(np.intersect1d(sets[i], sets[j], assume_unique=True))) >= 0.8 * (len(sets[i]) + len(sets[j]) - x)]
    kept = {r.doc_id for r in text_dedup.keep_one(docs).select("doc_id").collect()}
    caught = sum(not (rows[i].doc_id in kept and rows[j].doc_id in kept) for i, j in near)
    assert len(near) > 40 and caught >= 0.99 * len(near)
    group = {i: i for i in range(len(rows))}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in near:
        a, b = sorted((root(i), root(j)), key=lambda k: rows[k].doc_id)
        group[b] = a
    lone = {rows[i].doc_id for i in range(len(rows)) if root(i) == i and len(sets[i])}
    assert lone <= kept  # no text goes that has no similar one left


CLASH = ("rows", "_i", "_node", "node", "key", "i", "n", "asked", "c0", "_key", "root", "fp")


@pytest.mark.parametrize("name", CLASH)
def test_names_of_further_columns(spark, name):
    rows = [(1, BASE, "x"), (2, BASE, "y"), (2, BASE, "y"), (3, BASE + " today", "z"), (None, "other words", "w"), (4, None, "v"), (5, "", None)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` string")
    kept = text_dedup.keep_one(docs)
    assert kept.columns == ["doc_id", "text", name]
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id in (1, 4)  or doc_id is null").collect()))


def test_pipeline_on_hard_rows(spark, tmp_path):
    rows = [(1, BASE, "en"), (2, BASE, "en"), (2, BASE, "en"), (3, BASE + " today", "en"), (None, "le chat dort sur la table et les enfants jouent dans le jardin", "fr"), (4, None, "en"), (5, "", "en"), (6, " \t\n", "en"), (7, "12 ½ !!", "en")]
    rows += [(8, "she reads one two three four five six seven eight nine ten aloud", "en"), (9, "der hund schläft auf dem tisch " * 3000, "de"), (10, "plain words " + BASE.upper()[:40], "en")]
    # the fit needs words that stand in several labelled rows
    rng = np.random.default_rng(1)
    words = {"en": (BASE + " she reads one two three four five six seven eight nine ten aloud plain words").split(), "fr": "le chat dort sur la table et les enfants jouent dans le jardin".split()}
    more = [(100 + k, " ".join(rng.permutation(w)[:40]), lang) for lang, w in words.items() for k in range(10 * (lang == "fr"), 10 + 10 * (lang == "fr"))]
    rows += more
    table = [(i, t, lang, "s", len(t or ""), "c", "p") for i, t, lang in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, piece string, node string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    own = {i for i, _, _ in more}
    want = [{1, 2, 3, None, 8, 9, 10} | own, {1, None, 8, 9, 10} | own, {1, None, 9, 10} | own]
    for (_, stage), ids in zip(corpus_pipeline.STAGES, want):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        assert {r.doc_id for r in docs.collect()} == ids
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == want[-1] and max(r.offset + r.length for r in packed) <= 2048
    for r in packed:
        assert r.start == 2048 * r.piece


def test_pipeline_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
