"""The training-data operators against brute force, on small tables with hard cases."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from meshfold.llm import components, decontamination, embedding_dedup, language_id, license_scan, packing, sharding, simhash, text_dedup, token_counts, token_output, tokens, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, k long"
BASE = "the quick brown fox jumps over the lazy dog while a second fox sleeps near the old river bank and dreams of winter rain upon a silent green hill"
TEXTS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " today", "en", "a"), (3, BASE + " today", "en", "a"), (None, BASE, "en", None), (4, None, None, "b"), (5, "", "en", "b"), (6, " \t\n ", "en", "b"),
    (7, "Ünïcode étude, naïve! don't 12345 <|endoftext|> 終わり\x1c x\xa0y", "fr", "c"), (8, "word " * 5000, "en", "c"), (9, "Released under the MIT License.", "en", "c"), (10, "One line.\nLicensed under CC BY-NC 4.0.\n" + BASE, "en", "c"),
    (11, "le chat dort sur la table et les enfants jouent dans le jardin avec leur mère", "fr", "d"), (12, "der hund schläft auf dem tisch und die kinder spielen im garten mit ihrer mutter", "de", "d"), (13, "12345 !!", "en", "d"), (14, BASE.replace("winter", "summer").upper(), "en", "d"), (15, "x" * 70_000 + " " + "yz " * 30_000, "en", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, src, len(t) if t else 0, "clash", 0) for i, t, lang, src in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_odd_texts(tokenizer):
    rng = np.random.default_rng(1)
    letters = "abcdehiklnorstuäößéèñç'’.,-!0123 \n\tABCÉ<|>終ıİ́\x1c\xa0\x85 ẞΣσ²½"
    texts = ["".join(rng.choice(list(letters), rng.integers(0, 50))) + x for x in ("", "<|endoftext|>", "it's I'LL don't", "<|startoftext|>x", "a, b. c!! d") for _ in range(150)] + [None]
    want = [ids_of(tokenizer, t) for t in texts]
    ids, at = tokens.ItemEncoder(items=100).ids(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == want
    counter = token_counts.FieldCounter(limit=100)
    for chunk in (1, 7, 2048):
        assert token_counts.count_texts(counter, texts, chunk).tolist() == [len(w) for w in want]
    # one field over many chunks, in a scan of several levels
    long_ = ["x" * 5000, "ab" * 900 + " " + "終わり" * 300, " " * 3000, ""]
    assert token_counts.count_texts(counter, long_, 16).tolist() == [len(ids_of(tokenizer, t)) for t in long_]


def test_transducer_counts_other_scripts(tokenizer, monkeypatch):
    counter = token_counts.FieldCounter(limit=100)
    monkeypatch.setattr(counter, "by_library", None)  # no such field goes to the library
    texts = ["Привет, мир! Ёлка", "中文 文章。测试", "a\u0301 e\u0301te\u0301", "“quoted” — text…", "İstanbul ǅ ẞ", "１２３ Ⅷ ½", "\u200b\ufeff x\u3000y", "नमस्ते दुनिया", "😀 👍🏽 it’s"]
    assert token_counts.count_texts(counter, texts, 3).tolist() == [len(ids_of(tokenizer, t)) for t in texts]


def test_token_counts_of_no_rows(docs):
    assert token_counts.token_counts(docs.limit(0)).collect() == []


def test_token_output(spark, docs, tokenizer):
    got = [tuple(r) for r in token_output.read_shards(token_output.write_shards(docs, n_shards=3), 2).collect()]
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [ids_of(tokenizer, r[1]) + [1] for r in ordered]
    start = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    want = [(r[0], s, len(i), crc(i)) for r, s, i in zip(ordered, start, ids)]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_output.read_shards(token_output.write_shards(docs.limit(0))).collect() == []


def test_perfect_hash():
    keys = np.random.default_rng(2).choice(1 << 60, 5000, replace=False).astype(np.uint64)
    h = token_output.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))


def test_keyed_access(tmp_path):
    w = token_output.ShardWriter(f"file://{tmp_path}/x.ids", "<u2")
    for k, ids in ((None, [5]), (3, [1, 2]), (3, [7]), (9, [])):
        w.add(k, np.array(ids, "<u2").tobytes())
    w.close()
    r = token_output.ShardReader(f"file://{tmp_path}/x.ids")
    found = r.find(np.array([3, 9, 4]))
    assert [[r.read(e).tolist() for e in es] for es in found] == [[[1, 2], [7]], [[]], []]


def test_token_counts(docs, tokenizer):
    got = sorted(tuple(r) for r in token_counts.token_counts(docs, chunk=1000).na.fill(-1, ["doc_id"]).collect())
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(ids_of(tokenizer, t)), n > 2048) for i, t, *_ in TEXTS)
    assert got == want


def test_packing(docs, tokenizer):
    rows = packing.pack_documents(docs).collect()
    want = sorted(((i is not None, i or 0), k, s, len(p), crc(p)) for i, t, *_ in TEXTS for ids in [[*ids_of(tokenizer, t), 0]] for k, s in enumerate(range(0, len(ids), 2048)) for p in [ids[s : s + 2048]])
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048 and len(bins) == -(-sum(r.length for r in rows) // 2048)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    length = np.random.default_rng(3).integers(1, 100, 500)
    items = np.stack([length, np.ones(500), length**2], axis=1).astype(float)
    caps = np.array([100.0, 4.0, 6000.0])
    items = items[(items <= caps).all(axis=1)]
    bins = packing.best_fit(items, caps, np.ones(3), rule)
    total = np.zeros((bins.max() + 1, 3))
    np.add.at(total, bins, items)
    assert (total <= caps + 1e-6).all()


def brute_print(text, k=3):
    w = (text or "").encode().lower().split()
    h = [xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(n, linked):
    p = list(range(n))
    for _ in range(n):
        for i, j in linked:
            p[i] = p[j] = min(p[i], p[j])
    return p


def test_simhash(docs):
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    rows = sorted(TEXTS, key=lambda r: r[0] or 99)
    f = [brute_print(r[1]) for r in rows]
    p = brute_roots(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2])
    assert got == sorted((r[0] or 0, f"{x:016x}", rows[k][0]) for r, x, k in zip(rows, f, p))


@pytest.mark.parametrize("bits,segments,cap", [(2, 5, 4096), (2, 5, 8), (8, 9, 4096)])
def test_ring_finds_all(spark, bits, segments, cap):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).view(np.uint64)
    prints = {int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)) for b in base for k in (0, 1, 2, 3, bits, bits + 1)}
    prints = sorted(np.array(list(prints), np.uint64).view(np.int64).tolist())
    u = np.array(prints, np.int64).view(np.uint64)
    links = [tuple(x) for x in np.argwhere(np.triu(np.bitwise_count(u[:, None] ^ u) <= bits, 1))]
    want = brute_roots(len(u), links)
    found = simhash.ring_links(spark.createDataFrame([(x,) for x in prints], "fp long"), bits, segments, cap=cap)
    roots = {r.node: r.root for r in components.components(found).collect()}
    assert [roots.get(x, x) for x in prints] == [prints[k] for k in want]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)] + [(200, 200 + i) for i in range(1, 40)], "a long, b long")
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(61)) and roots[101] == 100 and all(roots[200 + i] == 200 for i in range(40))


def test_text_dedup(spark, docs):
    kept = text_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r[1] for r in TEXTS]
    p = brute_roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if text_dedup.similar(texts[i], texts[j]) >= 0.8])
    want = sorted(min(TEXTS[i][0] or 99 for i in range(len(texts)) if p[i] == k) for k in set(p))
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert text_dedup.keep_one(docs.limit(0)).collect() == []


def test_decontamination(spark, docs):
    items = [(1, "JUMPS over the lazy dog while a second fox sleeps near the old"), (2, "lazy dog"), (3, None), (4, ""), (None, "silent green hill"), (2, "word word"), (10, "nothing here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t, *_ in TEXTS:
        w = low(t)
        hit, names = np.zeros(len(w), bool), set()
        for item, text in items:
            q = low(text)
            for x in {tuple(q[a : a + 10]) for a in range(max(1, len(q) - 9))} if q else ():
                for a in range(len(w) - len(x) + 1):
                    if tuple(w[a : a + len(x)]) == x:
                        hit[a : a + len(x)] = True
                        names.add(item)
        names = sorted(str(x) for x in names - {None})
        want.append((i or 0, len(w), int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit.any())))
    for block in (8 << 20, 10):
        got = decontamination.decontaminate(docs, bench, shard_words=50, block_bytes=block).drop("spans").na.fill(0, ["doc_id"]).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    kept = decontamination.drop_contaminated(docs, bench)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(w[0] for w in want if not w[5])
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.predict(docs, language_id.fit_documents(docs)).withColumn("held_out", language_id.held_out("doc_id")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 300 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_id_hard_cases(docs):
    model = language_id.fit(docs.where("doc_id in (1, 11, 12)"))
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (13, "und"), (11, "fr"), (12, "de"), (1, "en")} <= got
    assert language_id.keep_identified(docs, model).columns == docs.columns
    empty = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs, shards=4).collect()
    assert len(rows) == len(TEXTS) and {r.law for r in rows} == {"bytes"}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    by_text = {}
    for i, t, *_ in TEXTS:
        by_text.setdefault(t or "", set()).update(r.shard for r in rows if r.text_crc32 == zlib.crc32((t or "").encode()))
    assert all(len(x) == 1 for x in by_text.values())
    assert sharding.shard_documents(docs.limit(0)).collect() == []


def test_shards_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    size = [r[0] for r in sharding.shard_documents(docs).groupBy("shard").sum("size").select("sum(size)").collect()]
    assert len(size) == 24 and max(size) < 1.02 * sum(size) / 24


def brute_links(vectors, least=0.95):
    def cosine(a, b):
        if not a or not b or len(a) != len(b) or any(x is None or not np.isfinite(x) for x in (*a, *b)):
            return 0
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return np.dot(a, b) / n if n else 0

    return [(i, j) for i in range(len(vectors)) for j in range(i) if cosine(vectors[i], vectors[j]) >= least]


@pytest.mark.parametrize("cap", [2048, 5])
def test_embeddings(spark, cap):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    vectors = [(b + 0.05 * rng.normal(size=16)).tolist() for b in base for _ in range(6)] + [base[0].tolist()] * 3 + [(2 * base[1]).tolist()]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.1]]
    rows = [(None if i == 3 else i, v) for i, v in enumerate(vectors)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cap=cap)
    links = brute_links(vectors)
    p = brute_roots(len(vectors), links)
    n = np.bincount(np.array(links).ravel(), minlength=len(vectors))
    found = {r.vec_id: r for r in got.collect()}
    assert all(found[i].n_links == n[i] and found[i].component_id == p[i] and found[i].kept == (p[i] == i) for i, _ in rows if i is not None)


def test_embeddings_recall(spark):
    """Groups of near vectors of many sizes among others, some in a second space of another length."""
    rng = np.random.default_rng(8)
    rows = []
    for dim, n in ((64, 1500), (1088, 60)):
        base = rng.normal(size=(n, dim))
        groups = [b + rng.uniform(0.02, 0.2) * rng.normal(size=(int(rng.integers(2, 9)), dim)) for b in base[: n // 3]] + [base[0] + 0.1 * rng.normal(size=(150 if dim == 64 else 3, dim))]
        rows += np.concatenate([base, *groups]).tolist()
    want = np.zeros(len(rows), np.int64)
    for dim in (64, 1088):
        at = [i for i, r in enumerate(rows) if len(r) == dim]
        x = np.array([rows[i] for i in at])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want[at] = (x @ x.T >= 0.95).sum(axis=1) - 1
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = np.array([r.n_links for r in embedding_dedup.near_duplicates(table).orderBy("vec_id").collect()])
    assert (got <= want).all() and want.sum() > 5000 and got.sum() >= 0.98 * want.sum()


def test_pivot_order():
    rng = np.random.default_rng(9)
    x, p = rng.normal(size=(50, 6)), rng.normal(size=(40, 6))
    near = embedding_dedup.nearest_pivots(x, p, 5)
    assert near.tolist() == [np.argsort(-(p @ v), kind="stable")[:5].tolist() for v in x]
    count = embedding_dedup.shared_pivots(near, near, 2)
    for i in range(50):
        for j in range(50):
            assert count[i, j] == sum(abs(a - b) <= 2 and near[i, a] == near[j, b] for a in range(5) for b in range(5))


def test_mixed_lengths(spark):
    """Lengths that agree modulo powers of two are different spaces."""
    rng = np.random.default_rng(10)
    near = lambda d: (np.ones(d) + 0.01 * rng.normal(size=d)).tolist()
    rows = [near(d) for d in (8, 1032, 512, 1536, 256, 1280) for _ in range(3)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(i, 2, i - i % 3) for i in range(18)]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding_dedup.near_duplicates(none).collect() == []


def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/1"), (2, "https://example.org/en/19?x"), (3, "https://notexample.org/es/1"), (4, "x.com/fr/"), (5, None), (6, "http://b.com/de/5#t"), (7, "http://b.com"), (8, "a://h?://q/p"), (8, "a://h?://q/p"), (9, "")]
    got = sorted((r.page_id, r.host, r.path, r.rule) for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got == sorted([(1, "a.example.org", "/es/1", "example.org/es/"), (2, "example.org", "/en/19", "example.org/en/1"), (3, "notexample.org", "/es/1", "org/"), (4, "", "", None), (5, "", "", None), (6, "b.com", "/de/5", "com/de/"), (7, "b.com", "", None), (8, "h", "", None), (8, "h", "", None), (9, "", "", None)], key=lambda r: r[:2] + (r[2], r[3] or ""))
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_licenses(spark, docs):
    from pyspark.sql import functions as F

    rows = {r.doc_id: r for r in license_scan.scan(docs, "doc_id", F.concat(F.lit("c/"), F.col("doc_id").cast("string")), file_share=0.3).collect()}
    assert (rows[9].license, rows[9].origin) == ("MIT", "own") and (rows[10].license, rows[10].origin) == ("CC-BY-NC-4.0", "own")
    assert (rows[1].license, rows[1].origin, rows[1].from_dir) == ("MIT", "inherited", "c") and rows[4].license == "MIT"
    assert rows[None].origin == "none"
    assert license_scan.scan(docs.limit(0), "doc_id", F.lit("a/b")).collect() == []


def test_numerals_are_no_letters(spark):
    texts = ["½ ² ① Ⅷ", "12 ½", "日本語", "一二", "ªº", "x²", "é", "_ __"]
    have = [bool(language_id.letters_of(t)) for t in texts]
    assert have == [False, False, True, True, True, True, True, False]
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(["the quick brown fox", "le chat dort"] * 5 + texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 10"), least_words=1, least_grams=1)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert [got[10 + i] == "und" for i in range(len(texts))] == [not h for h in have]


def test_unknown_text_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_documents(docs)
    odd = spark.createDataFrame([(1, "xqzzkv wqjjx zzqkrt qxqxw vvkqz"), (2, "これは日本語の文章です"), (3, docs.where("lang = 'en' and n_chars > 300").first()["text"])], "doc_id long, text string")
    assert [r.doc_id for r in language_id.keep_identified(odd, model).collect()] == [3]
    lettered = docs.where(docs.text.rlike("[A-Za-z]{3}"))
    assert language_id.keep_identified(docs, model).count() >= 0.99 * lettered.count()
