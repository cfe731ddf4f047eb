"""Language identification by words first, then by ever shorter character n-grams.

Fit, on a bounded sample of labelled rows: per language, the log frequency of the words that the sample has at least
`least_words` times, and of the character n-grams (lengths 5 to 1, with word edges) that at least `least_grams` of its
distinct words have. Score: a known word adds its per-language log frequencies; an unseen one is covered by n-grams, at
each position the longest that the model knows, and adds their mean log frequencies. Score of a text: the posterior of
the best language under equal priors, with the evidence of a word tempered.

A letter is what Unicode classes as one; digits, fractions, circled and Roman numerals are none.

Cases: a text that is null or has no letter is `und` with score 0; ties go to the language first in order;
a null id is in the training part only if its remainder says so, which it cannot, and is not held out; without
any labelled row every text is `und`; repeated rows count once in the fit and are scored alike; an empty table gives
no rows; texts are scored whole; further columns are not read, or passed through.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, giving_back, materialize, slices

UNKNOWN = "und"
LONGEST = 5
TEMPER = 0.5


_RUNS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _numerals() -> frozenset:
    """Numerals that are word characters but no digits, such as fractions and Roman ones."""
    return frozenset(c for c in map(chr, range(0x80, 0x110000)) if c.isnumeric() and not c.isalpha())


def letters_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    text = text.lower()
    runs = _RUNS.findall(text)
    odd = _numerals().intersection("".join(w for w in set(runs) if not w.isascii()))
    return _RUNS.findall(text.translate(dict.fromkeys(map(ord, odd), " "))) if odd else runs


def _fold_counts(batches):
    """Word counts by language of a task's share of the sample."""
    counts: dict[str, Counter] = {}
    for b in slices(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(letters_of(text))
    for lang, c in counts.items():
        items = list(c.items())
        for at in range(0, len(items), 20_000):
            part = items[at : at + 20_000]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(part), "word": [w for w, _ in part], "n": pa.array([n for _, n in part], pa.int64())})


class Model:
    """Languages in order, and the rows of log frequencies of words and n-grams."""

    def __init__(self, langs: list[str], words: list[str], word_rows: np.ndarray, grams: list[str], gram_rows: np.ndarray, unseen: np.ndarray):
        self.langs, self.word_rows, self.gram_rows, self.unseen = langs, word_rows, gram_rows, unseen
        self.words = {w: i for i, w in enumerate(words)}
        self.grams = {g: i for i, g in enumerate(grams)}


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *, key: str = "doc_id", max_rows: int = 4000, least_words: int = 3, least_grams: int = 3) -> Model:
    """Fit on the max_rows distinct labelled rows with the least hash, whole texts.

    If no word is that frequent, or no n-gram, all of the sample's count. The sample bounds the model's size.
    """
    sample = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(key, text_col, lang_col).alias("h")).where("lang is not null and text is not null")
    # the bound is found on the hashes alone; only chosen texts move
    last = sample.select("h").distinct().orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    chosen = sample.where(F.col("h") <= F.lit(last).cast("long")).dropDuplicates(["h"]).select("lang", "text")
    counts = chosen.mapInArrow(giving_back(_fold_counts), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "language-words")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        discard(counts)
        return Model([], [], np.zeros((0, 0), np.float32), [], np.zeros((0, 0), np.float32), np.zeros(0))
    place = {x: i for i, x in enumerate(langs)}
    edged = F.concat(F.lit("␂"), "word", F.lit("␃"))
    gram = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - k + 1, F.lit(1))), lambda i: F.substring(F.col("w"), i, k)))))
    grams = counts.select("lang", edged.alias("w")).select("lang", gram.alias("g")).groupBy("lang", "g").agg(F.count("*").alias("n"))
    grams = materialize(grams, "language-grams")

    def table(df, col, least):
        """The names, their rows, and the row of what was not seen."""
        total = {r["lang"]: r["t"] for r in df.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
        rows = df.where(F.col("n") >= least).select("lang", col, "n").toArrow()  # bounded by the sample
        rows = rows if rows.num_rows else df.select("lang", col, "n").toArrow()
        coded = rows[col].combine_chunks().dictionary_encode()
        names, n = coded.dictionary.to_pylist(), np.zeros((len(coded.dictionary), len(langs)))
        n[coded.indices.to_numpy(), [place[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
        size = np.array([total.get(x, 0) for x in langs], float) + 0.5 * len(names)
        return names, np.log((n + 0.5) / size).astype(np.float32), np.log(0.5 / size)

    words, word_rows, _ = table(counts, "word", least_words)
    names, gram_rows, unseen = table(grams, "g", least_grams)
    for used in (counts, grams):
        discard(used)
    return Model(langs, words, word_rows, names, gram_rows, unseen)


class Scorer:
    def __init__(self, model: Model, limit: int = 150_000):
        self.m, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.m.langs) + 1))  # the last column: whether the model knows the word

    def word(self, w: str) -> tuple[np.ndarray, float]:
        """The word's log frequencies, and 1 if it is known or n-grams of three characters or more cover half of it."""
        known = self.m.words.get(w)
        if known is not None:
            return self.m.word_rows[known], 1.0
        t, at, parts, long_, grams = f"␂{w}␃", 0, [], 0, self.m.grams
        unseen = 0
        while at < len(t):
            for k in range(min(LONGEST, len(t) - at), 0, -1):
                g = grams.get(t[at : at + k])
                if g is not None:
                    parts.append(g)
                    long_ += k if k > 2 else 0
                    break
            else:
                k = 1
                unseen += 1
            at += k
        total = self.m.gram_rows[parts].sum(axis=0, dtype=float) + unseen * self.m.unseen
        return total / (len(parts) + unseen), float(2 * long_ >= len(t))

    def posterior(self, text: str | None) -> tuple[str, float, float]:
        """The language, its score, and the share of the text's words that the model knows."""
        fields = letters_of(text) if text else []
        if not fields or not self.m.langs:
            return UNKNOWN, 0.0, 0.0
        new = set(fields).difference(self.place)
        if new:
            if len(self.place) + len(new) > self.limit:
                self.clear()
                new = set(fields)
            while len(self.place) + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for w in new:
                at = self.place[w] = len(self.place)
                self.rows[at, :-1], self.rows[at, -1] = self.word(w)
        at = np.fromiter(map(self.place.__getitem__, fields), np.int64, len(fields))
        total = self.rows[at].sum(axis=0)
        s = total[:-1] * TEMPER
        p = np.exp(s - s.max())
        best = int(s.argmax())
        return self.m.langs[best], min(1.0, float(p[best] / p.sum())), float(total[-1] / len(fields))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; no shuffle. The model's size is bounded by fit's parameters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for b in slices(batches):
            got = [scorer.posterior(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "lang_pred": pa.array([x for x, _, _ in got], pa.string()), "score": pa.array([s for _, s, _ in got], pa.float64())})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(giving_back(run), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", *, least: float = 0.0, least_known: float = 0.1) -> DataFrame:
    """The rows whose language is identified. All columns pass through.

    Rows that are `und` go, and those with a posterior below `least`, and those of whose words the model knows less
    than `least_known` (by themselves or by their n-grams): no learned language, or no language. The fit must have seen
    enough labelled text for that; a model of no labelled rows keeps nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(sent.value)
        for b in slices(batches):
            got = [scorer.posterior(t) for t in b.column(place).to_pylist()]
            yield b.filter(pa.array([x != UNKNOWN and s >= least and k >= least_known for x, s, k in got], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit_documents(docs)).withColumn("held_out", held_out("doc_id"))
