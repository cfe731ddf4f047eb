"""License scans by sparse TF-IDF cosine and nearest-ancestor inheritance, in DataFrame functions only.

Every line of every whole text that speaks of a licence is a candidate header. Candidates are grouped by their
text before anything is scored, so a header that a third of all files share is one row. A term's weight is its
count times ln((1 + N) / (1 + df)) + 1, N and df counting all candidate lines. A file takes the template with
the largest cosine over its lines if that reaches `least`; ties go to the licence first in order. A file whose
licensed lines make up at least `file_share` of its text is a licence file and stands for its directory. A file
without a licence of its own takes that of the nearest directory at or above its own which has one; this is a
join on the distinct directories' ancestor paths.

Besides, an SPDX tag names the licence with score 1; a whole text that reaches `least` against a full licence text
(`licences/`) is a licence file, whatever its lines say; and a file with none of these and no line that reaches
`least` takes the best window of as many words as a template or a short full text has, across lines and inside
longer ones, if that reaches `least_window`. Their weights are (1 + ln count) times ln((1 + N) / (1 + df)) + 1
over the templates alone, so they do not depend on the table. Precedence: tag, whole text, line, window.

Cases: a null or empty text has no licence of its own but may inherit; a null path has no directory and no
inheritance; a row that repeats (same id, path and text) is one file, so its lines count once, and all of its rows are
judged alike; rows that share id and path but not the text are files of their own; of several licence files in a
directory the best score, then the licence first in order, counts; an empty table gives no rows; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Short licence notices by SPDX id; fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License (CC BY-NC 4.0)."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
_KEY = "(?i)licen[cs]e|copyright|spdx"
#: Words that notices and licence texts contain.
_ANCHOR = "licen[cs]|copyright|hereby|redistribution"
_TAG = r"(?i)spdx-license-identifier:\s*\(?\s*([a-z0-9.+-]*[a-z0-9+])"
_FULL = sorted((p.stem, p.read_text(errors="replace")) for p in (Path(__file__).parent / "licences").glob("*.txt"))
_FILE = ["doc_id", "path", "size", "key"]
#: Full texts of more words are compared with whole files only.
WINDOW_WORDS = 300


def _terms(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda t: t != "")


def scan(files: DataFrame, id_col: str, path: Column, text_col: str = "text", *, templates=TEMPLATES, least: float = 0.6, file_share: float = 0.3, least_window: float = 0.8) -> DataFrame:
    """doc_id, path, license, score, origin (own, inherited, none), from_dir of every row."""
    spark = files.sparkSession
    text = F.col(text_col).cast("string")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_KEY))
    key = F.sha2(F.coalesce(text, F.lit("")), 256)
    rows = files.select(F.col(id_col).alias("doc_id"), path.cast("string").alias("path"), lines.alias("lines"), F.length(text).alias("size"), key.alias("key"))
    # a file is an id, a path and a text; its rows count once
    found = materialize(rows.where(F.size("lines") > 0).dropDuplicates(_FILE).select(*_FILE, F.explode("lines").alias("line")), "licence-lines")
    kinds = found.groupBy("line").agg(F.count("*").alias("n"))
    terms = kinds.select("line", "n", F.explode(_terms(F.col("line"))).alias("term")).groupBy("line", "n", "term").agg(F.count("*").alias("tf"))
    whole = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    known = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(i).alias("template"), F.lit(k).alias("license"), F.lit(t).alias("body")) for i, (k, t) in enumerate(templates)))))
    wanted = known.select("template", "license", F.explode(_terms(F.col("body"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tt"))
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((1 + F.col("all")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    # whole is one row; the templates are a short parameter
    lined = terms.join(df, "term").join(F.broadcast(whole)).select("line", "term", (F.col("tf") * idf).alias("x"))
    sized = lined.groupBy("line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    asked = F.broadcast(wanted.join(df, "term", "left").join(F.broadcast(whole)).select("template", "license", "term", (F.col("tt") * idf).alias("y")))
    lengths = asked.groupBy("template").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("length"))
    dots = lined.join(asked, "term").groupBy("line", "template", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(sized, "line").join(F.broadcast(lengths), "template").select("line", "license", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 6).alias("score"))
    # written, so that a line that many files have can be split at run time
    best = materialize(scored.where(F.col("score") >= least).groupBy("line").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("license")), "licence-best")
    matched = found.join(best, "line").groupBy(*_FILE).agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("license"), F.sum(F.length("line")).alias("licensed"))
    return _inherit(rows, _with_passages(files.select(F.col(id_col).alias("doc_id"), path.cast("string").alias("path"), F.length(text).alias("size"), key.alias("key"), text.alias("text")), matched, templates, least, least_window), file_share)


def _words(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def _passage_scores(passages: DataFrame, bodies, everything, least: float) -> DataFrame:
    """passage, score, license: the best of `bodies` (license, text) for each distinct array of words that reaches `least`."""
    spark = passages.sparkSession
    df = Counter(t for _, b in everything for t in set(_words(b)))
    idf = {t: math.log((1 + len(everything)) / (1 + n)) + 1 for t, n in df.items()}
    vectors: dict[str, list[float]] = {t: [0.0] * len(bodies) for t in idf}
    for i, (_, b) in enumerate(bodies):
        y = {t: (1 + math.log(c)) * idf[t] for t, c in Counter(_words(b)).items()}
        length = math.sqrt(sum(v * v for v in y.values()))
        for t, v in y.items():
            vectors[t][i] = v / length
    # the templates are a parameter
    known = F.broadcast(spark.createDataFrame([(t, idf[t], y) for t, y in vectors.items()], "term string, idf double, y array<double>"))
    terms = passages.select("passage", F.explode("words").alias("term")).groupBy("passage", "term").agg(F.count("*").alias("tf"))
    x = terms.join(known, "term", "left").select("passage", "y", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(math.log(1 + len(everything)) + 1))).alias("x"))
    dots = x.groupBy("passage").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *(F.sum(F.col("x") * F.col("y")[i]).alias(f"d{i}") for i in range(len(bodies))))
    scores = F.array(*(F.struct(F.round(-F.coalesce(f"d{i}", F.lit(0.0)) / F.col("norm"), 6).alias("s"), F.lit(k).alias("k")) for i, (k, _) in enumerate(bodies)))
    best = dots.select("passage", F.array_min(scores).alias("b"))
    return best.where(-F.col("b.s") >= least).select("passage", (-F.col("b.s")).alias("score"), F.col("b.k").alias("license"))


def _with_passages(texts: DataFrame, matched: DataFrame, templates, least: float, least_window: float) -> DataFrame:
    """The matches of lines, and those of tags, whole texts and windows."""
    ids = sorted({k for k, _ in templates} | {k for k, _ in _FULL})
    known = F.create_map(*(F.lit(x) for k in ids for name in (k, f"{k}-only", f"{k}-or-later", f"{k}+") for x in (name.lower(), k)))
    spoken = texts.where(F.col("text").rlike(f"(?i){_ANCHOR}|spdx"))
    tags = spoken.select(*_FILE, F.explode(F.regexp_extract_all("text", F.lit(_TAG), 1)).alias("tag")).select(*_FILE, known[F.lower("tag")].alias("license")).where("license is not null")
    # of several tags the licence first in order
    tagged = tags.groupBy(*_FILE).agg(F.min("license").alias("license")).select(*_FILE, F.lit(1.0).alias("score"), "license", F.lit(0).alias("licensed"), F.lit(0).alias("rank"))

    everything = [*templates, *_FULL]
    # steps are written, as later ones read them more than once
    worded = materialize(spoken.dropDuplicates(_FILE).select(*_FILE, _terms(F.col("text")).alias("words")).withColumn("passage", F.sha2(F.array_join("words", " "), 256)), "licence-words")
    short = min(len(_words(b)) for _, b in _FULL) // 2
    # a text shares its scores with its copies
    large = worded.where(F.size("words") >= short)
    whole = _passage_scores(large.select("passage", "words").dropDuplicates(["passage"]), _FULL, everything, least)
    files = large.select(*_FILE, "passage").join(whole, "passage").select(*_FILE, "score", "license", F.col("size").alias("licensed"), F.lit(1).alias("rank"))
    lines = matched.select(*_FILE, "score", "license", "licensed", F.lit(2).alias("rank"))
    found = materialize(tagged.unionByName(files).unionByName(lines), "licence-found")

    pieces = [*templates, *((k, b) for k, b in _FULL if len(_words(b)) <= WINDOW_WORDS)]
    sizes = sorted({len(_words(b)) for _, b in pieces})
    keys = [worded[c].eqNullSafe(F.col(f"_{c}")) for c in _FILE]
    done = found.select(*(F.col(c).alias(f"_{c}") for c in _FILE)).distinct()
    left = materialize(worded.join(done, reduce(Column.__and__, keys), "left_anti"), "licence-left")
    at = left.select(*_FILE, "words", F.posexplode("words").alias("pos", "word")).where(F.col("word").rlike(_ANCHOR))
    starts = F.flatten(F.array(*(F.transform(F.sequence(F.greatest(F.col("pos") - (n - 1), F.lit(0)), F.col("pos"), F.lit(max(1, n // 10))), lambda s, n=n: F.struct(s.alias("from"), F.lit(n).alias("n"))) for n in sizes)))
    windows = at.select(*_FILE, "words", F.explode(starts).alias("s")).select(*_FILE, F.slice("words", F.col("s.from") + 1, F.col("s.n")).alias("words")).withColumn("passage", F.array_join("words", " "))
    windows = materialize(windows.distinct(), "licence-windows")
    best = _passage_scores(windows.select("passage", "words").distinct(), pieces, everything, least_window)
    inside = windows.join(best, "passage").groupBy(*_FILE).agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("license")).select(*_FILE, "score", "license", F.lit(0).alias("licensed"), F.lit(3).alias("rank"))
    first = F.struct("rank", -F.col("score"), F.col("license"))
    every = found.unionByName(inside).groupBy(*_FILE).agg(F.min_by("score", first).alias("score"), F.min_by("license", first).alias("license"), F.sum("licensed").alias("licensed"))
    return materialize(every, "licence-own")


def directory(path: Column) -> Column:
    return F.when(path.isNotNull(), F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def _inherit(rows: DataFrame, matched: DataFrame, file_share: float) -> DataFrame:
    own = matched.select(F.col("doc_id").alias("i"), F.col("path").alias("p"), F.col("size").alias("s"), F.col("key").alias("k"), "score", "license", "licensed")
    grants = own.where(F.col("p").isNotNull() & (F.col("licensed") >= file_share * F.col("s"))).groupBy(directory(F.col("p")).alias("from_dir")).agg(F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("given"))
    dirs = rows.select(directory(F.col("path")).alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("from_dir")))).alias("a")).select("dir", "a.*")
    # written, so that a directory of many files can be split at run time
    nearest = materialize(above.join(grants, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "given"), "depth").alias("up")), "licence-dirs")
    base = rows.select(*_FILE, directory(F.col("path")).alias("dir"))
    same = base.doc_id.eqNullSafe(F.col("i")) & base.path.eqNullSafe(F.col("p")) & base["size"].eqNullSafe(F.col("s")) & (base.key == F.col("k"))
    held = base.join(own, same, "left").join(nearest, "dir", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited").otherwise("none")
    return held.select("doc_id", "path", F.coalesce("license", "up.given").alias("license"), F.coalesce("score", F.lit(0.0)).alias("score"), origin.alias("origin"), F.when(origin == "inherited", F.col("up.from_dir")).alias("from_dir"))


def document_path() -> Column:
    """Where a document stands: a tree of its source and two ranges of its doc_id, at one of three depths."""
    i = F.col("doc_id")
    wide, narrow = F.floor(i / 1000).cast("string"), F.floor(i / 100).cast("string")
    top = F.coalesce("source", F.lit(""))
    return F.when(i % 3 == 0, F.concat_ws("/", top, i.cast("string"))).when(i % 3 == 1, F.concat_ws("/", top, wide, i.cast("string"))).when(i.isNotNull(), F.concat_ws("/", top, wide, narrow, i.cast("string")))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", document_path())


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(k)}, {quote(t)})" for i, (k, t) in enumerate(TEMPLATES))
    terms = lambda c: f"unnest(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda t: t <> ''))"
    return f"""
WITH f AS (SELECT doc_id, text, length(text) AS size, CASE doc_id % 3 WHEN 0 THEN coalesce(source, '') || '/' || doc_id
 WHEN 1 THEN coalesce(source, '') || '/' || (doc_id // 1000) || '/' || doc_id
 WHEN 2 THEN coalesce(source, '') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || doc_id END AS path FROM documents),
found AS (SELECT * FROM (SELECT doc_id, path, size, unnest(string_split(text, chr(10))) AS line FROM f) WHERE regexp_matches(line, '{_KEY}')),
kinds AS (SELECT line, count(*) AS n FROM found GROUP BY line),
terms AS (SELECT line, n, term, count(*) AS tf FROM (SELECT line, n, {terms("line")} AS term FROM kinds) GROUP BY ALL),
total AS (SELECT coalesce(sum(n), 0) AS al FROM kinds),
df AS (SELECT term, sum(n) AS df FROM terms GROUP BY term),
wanted AS (SELECT template, license, term, count(*) AS tt FROM (SELECT template, license, {terms("body")} AS term FROM (VALUES {values}) v(template, license, body)) GROUP BY ALL),
lined AS (SELECT line, term, tf * (ln((1 + al)::double / (1 + coalesce(df, 0))) + 1) AS x FROM terms JOIN df USING (term), total),
asked AS (SELECT template, license, term, tt * (ln((1 + al)::double / (1 + coalesce(df, 0))) + 1) AS y FROM wanted LEFT JOIN df USING (term), total),
sized AS (SELECT line, sqrt(sum(x * x)) AS norm FROM lined GROUP BY line),
lengths AS (SELECT template, sqrt(sum(y * y)) AS length FROM asked GROUP BY template),
scored AS (SELECT line, license, round(dot / (norm * length), 6) AS score FROM (SELECT line, template, license, sum(x * y) AS dot FROM lined JOIN asked USING (term) GROUP BY ALL) JOIN sized USING (line) JOIN lengths USING (template)),
best AS (SELECT line, score, license FROM scored WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
m AS (SELECT doc_id, path, size, line, score, license FROM found JOIN best USING (line)),
own AS (SELECT doc_id, path, max(size) AS size, sum(length(line)) AS licensed, max(score) AS score, arg_min(license, (-score, license)) AS license FROM m GROUP BY doc_id, path),
grants AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS from_dir, arg_min(license, (-score, license)) AS given FROM own WHERE licensed >= 0.3::double * size GROUP BY 1),
dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f WHERE path IS NOT NULL),
above AS (SELECT dir, k AS depth, array_to_string(string_split(dir, '/')[1:k], '/') AS from_dir FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM dirs)),
nearest AS (SELECT dir, arg_max(from_dir, depth) AS from_dir, arg_max(given, depth) AS given FROM above JOIN grants USING (from_dir) GROUP BY dir)
SELECT f.doc_id, f.path, coalesce(o.license, n.given) AS license, coalesce(o.score, 0.0::double) AS score,
 CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
 CASE WHEN o.license IS NULL THEN n.from_dir END AS from_dir
FROM f LEFT JOIN own o ON f.doc_id = o.doc_id AND f.path = o.path LEFT JOIN nearest n ON regexp_extract(f.path, '^(.*)/[^/]*$', 1) = n.dir"""


OP4_SQL = _sql()
