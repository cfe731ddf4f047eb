"""Paths of more than two segments."""

from meshfold.llm import url_filters


def test_deep_paths(spark):
    rules = [("block", "h.net", "/en/blog/spam/x/bad"), ("allow", "h.net", "/en/blog/news/x/good"), ("block", "h.net", "/a/b/c/d/e/bad"), ("allow", "h.net", "/a/b/c/d/f/good")]
    paths = [p for p in ("/en/blog/spam/x/bad", "/en/blog/news/x/good", "/a/b/c/d/e/bad", "/a/b/c/d/f/good") for _ in range(40)]
    paths += [p for p in ("/en/blog/spam/x/other", "/en/blog/news/x/other", "/a/b/c/d/e/other", "/a/b/c/d/f/other") for _ in range(3)]
    pages = spark.createDataFrame([(i, f"http://h.net{p}") for i, p in enumerate(paths)], "page_id long, url string")
    got = {(r.path, r.verdict, r.template) for r in url_filters.filter_urls(pages, rules=rules).collect() if r.path.endswith("other")}
    assert {(p, v) for p, v, _ in got} == {("/en/blog/spam/x/other", "block"), ("/en/blog/news/x/other", "allow"), ("/a/b/c/d/e/other", "block"), ("/a/b/c/d/f/other", "allow")}
    assert all(p == t for p, _, t in got)


def test_similar_sparse_siblings_are_pooled(spark):
    """Each of four branches has two blocked urls, too few alone against a host that is mostly allowed."""
    names = ("ba", "bb", "bc", "bd")
    rules = [("allow", "h.net", "/good")] + [("block", "h.net", f"/{b}/bad") for b in names]
    paths = [f"/good/{x}" for x in "uvwxyz" for _ in range(10)] + [f"/{b}/bad" for b in names for _ in range(2)] + [f"/{b}/other" for b in names] + ["/new/page"] * 3
    pages = spark.createDataFrame([(i, f"http://h.net{p}") for i, p in enumerate(paths)], "page_id long, url string")
    verdict = lambda p: {r.path: r.verdict for r in url_filters.filter_urls(p, rules=rules).collect()}
    assert {verdict(pages)[f"/{b}/other"] for b in names} == {"block"} and verdict(pages)["/new/page"] == "allow"
    alone = pages.where(~pages.url.rlike("/b[bcd]/"))
    assert verdict(alone)["/ba/other"] == "allow"


def test_sql_on_deep_paths(spark):
    """The DuckDB form on random paths of up to three segments."""
    import random

    import duckdb

    rng = random.Random(5)
    urls = [f"http://{rng.choice(['a.com', 'x.example.org', 'b.net', 'c.org'])}/" + "/".join(rng.choice(["fr", "de", "es", "en", "page", "p1", "q"] ) for _ in range(rng.randint(0, 3))) for _ in range(3000)] + [None, "none", "http://a.com"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    con = duckdb.connect()
    table = pages.toArrow()
    con.register("pages", table)
    want = con.execute(url_filters.OP9_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in url_filters.filter_urls(pages).collect()))) == sorted(map(str, want.fetchall()))
