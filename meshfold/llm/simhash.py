"""SimHash near-duplicates with a pigeonring filter.

A 64-bit fingerprint is cut into m segments on a ring. If two differ in at most t bits then, from some start,
every chain of l consecutive segments differs in at most floor(l * t / m) bits. The longest chains with budget
0 are the index keys. What meets under a key is pruned by the chains of growing length, budget by budget; the
chain of all m segments is the full Hamming check.

Keys of many fingerprints are dealt into blocks; each pair of blocks is a task's unit, so no task holds more
than two blocks of a key and no pair is lost. Tasks keep only a spanning star of what they link.

Cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any other; rows
with one fingerprint are one node; a null id has a row but is never a component's id unless all its ids are
null; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import giving_back, materialize, slices
from .components import local_roots, stars

SEED = 42


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of the text, A-Z lower-cased; of the whole if it has fewer words."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= k:
        return np.array([xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    n = len(w) - k + 1
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(k)))), repeat(SEED)), np.uint64, n)


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """A bit is 1 if it is set in over half of the (weighted) hashes."""
    if not hashes.size:
        return 0
    counts, whole = np.zeros(64), 0.0
    for at in range(0, hashes.size, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if weights is None:
            counts += bits.sum(axis=0, dtype=np.int64)
            whole += len(bits)
        else:
            w = weights[at : at + (1 << 16)]
            counts += w @ bits
            whole += w.sum()
    return int(np.packbits(2 * counts > whole, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, k: int) -> int:
    return majority(shingle_hashes(text, k))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3) -> DataFrame:
    """doc_id and fp (as a signed long) of every row; no shuffle."""

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": pa.array(fp)})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(giving_back(run), "doc_id long, fp long")


class Ring:
    """Segments, budgets and keys for t bits in m segments."""

    def __init__(self, bits: int, m: int):
        self.t, self.m = bits, m
        self.cuts = [64 * i // m for i in range(m + 1)]
        self.chain = max([n for n in range(1, m + 1) if n * bits // m == 0], default=0)
        if not self.chain:
            raise ValueError("more segments than bits are needed")
        self.masks = np.zeros((m, m + 1), np.uint64)
        for i in range(m):
            for n in range(1, m + 1):
                j = (i + n - 1) % m
                self.masks[i, n] = self.masks[i, n - 1] | np.uint64((1 << self.cuts[j + 1]) - (1 << self.cuts[j]))

    def keys(self, fp: Column) -> Column:
        """The (start, exact bits) of each start."""
        signed = self.masks.view(np.int64)
        return F.array(*(F.struct(F.lit(i).alias("start"), fp.bitwiseAND(F.lit(int(signed[i, self.chain]))).alias("part")) for i in range(self.m)))

    def near(self, start: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs stay within every budget from their start on."""
        x, left = a ^ b, np.arange(len(a))
        for n in range(self.chain + 1, self.m + 1):
            left = left[np.bitwise_count(x[left] & self.masks[start[left], n]) <= n * self.t // self.m]
        return left

    def first_start(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first start from which the pair stays within every budget."""
        out, open_ = np.full(len(a), self.m), np.arange(len(a))
        for i in range(self.m):
            x = (a ^ b)[open_]
            ok = np.ones(len(open_), bool)
            for n in range(1, self.m + 1):
                ok &= np.bitwise_count(x & self.masks[i, n]) <= n * self.t // self.m
            out[open_[ok]] = i
            open_ = open_[~ok]
        return out


def same_key_pairs(key: np.ndarray, block: int = 1 << 21):
    """(i, j), i < j, of all places with the same key, keys being in order; at most about `block` pairs at a time."""
    n = len(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    end = np.repeat(first + size, size)
    left = end - np.arange(n) - 1
    rows = np.flatnonzero(left)
    total = np.cumsum(left[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + block)))
        r, m = rows[at:to], left[rows[at:to]]
        i = np.repeat(r, m)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        at = to


def dealt(rows: DataFrame, key: list[str], salt: Column, cap: int) -> DataFrame:
    """Add lo, hi (a pair of blocks) and own (the row's block): a key of more than cap rows meets itself block by block."""
    hot = materialize(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > cap), "hot-keys")
    if not hot.head(1):
        return rows.withColumns({"lo": F.lit(0), "hi": F.lit(0), "own": F.lit(0)})
    n = F.coalesce(F.ceil(F.col("n") / cap).cast("int"), F.lit(1))
    spread = rows.join(hot, key, "left").withColumn("blocks", n).withColumn("own", F.pmod(salt, F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("n", "blocks", "other")


def group_numbers(t: pa.Table, key: list[str]) -> np.ndarray:
    """The running number of each row's group, rows being in key order."""
    new = np.zeros(max(t.num_rows - 1, 0), bool)
    for c in key:
        x = t[c].to_numpy()
        new |= x[1:] != x[:-1]
    return np.cumsum(np.r_[np.zeros(min(t.num_rows, 1), bool), new])


def whole_groups(batches, key: list[str], rows: int = 200_000):
    """Tables of about `rows` rows in key order that cut no group."""
    rest: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        rest.append(b)
        held += b.num_rows
        if held >= rows:
            t = pa.Table.from_batches(rest)
            n = group_numbers(t, key)
            last = int(np.searchsorted(n, n[-1]))
            if last:
                yield t.slice(0, last)
            rest = t.slice(last).combine_chunks().to_batches()
            held = sum(x.num_rows for x in rest)
    if held:
        yield pa.Table.from_batches(rest)


def ring_links(prints: DataFrame, bits: int = 2, segments: int = 5, *, cap: int = 4096) -> DataFrame:
    """Spanning links (a, b) of all pairs of distinct fingerprints fp that differ in at most `bits` bits."""
    ring = Ring(bits, segments)
    rows = prints.select("fp", F.explode(ring.keys(F.col("fp"))).alias("k")).select("fp", "k.*")
    rows = dealt(rows, ["start", "part"], F.xxhash64("fp"), cap)

    def link(start, key, fp):
        out = [(np.zeros(0, np.uint64),) * 2]
        for i, j in same_key_pairs(key):
            ok = ring.near(start[i], fp[i], fp[j])
            out.append((fp[i[ok]], fp[j[ok]]))
        return local_roots(*(np.concatenate(x).view(np.int64) for x in zip(*out)))

    def run(batches):
        for t in whole_groups(batches, order):
            fp = t["fp"].to_numpy()
            a, b = link(t["start"].to_numpy(), group_numbers(t, order), fp.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    order = ["start", "part", "lo", "hi"]
    return rows.select(*order, "fp").repartition(*(F.col(c) for c in order)).sortWithinPartitions(*order).mapInArrow(giving_back(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, bits: int = 2, segments: int = 5) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = materialize(fingerprints(docs, id_col, text_col, words=words), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = stars(ring_links(classes.select("fp"), bits, segments))
    joined = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = joined.where("root is not null").join(roots.select("root").distinct(), "root", "left_semi")
    lows = linked.groupBy("root").agg(F.min("least").alias("low"))
    moved = materialize(linked.join(lows, "root").select("fp", "low"), "moved")
    # written, so that a fingerprint that many rows have can be split at run time
    ids = materialize(classes.join(moved, "fp", "left").select("fp", F.coalesce("low", "least").alias("component_id")), "fingerprint-classes")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
