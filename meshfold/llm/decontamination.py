"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents, all words of whole texts, each document with an end mark of its own. Its suffix array
gives the Burrows-Wheeler transform, kept as a wavelet matrix with bit ranks. The index is built once; then the windows
of every block of the benchmark are searched backwards, all of a block at once; occurrences are located by walks to
sampled suffix positions; their spans are merged per document.

The benchmark goes to the workers in blocks of at most `block_bytes` of text, each a broadcast of its own, of which a
worker holds `_HELD` in memory; so any benchmark fits.

Cases: null texts and texts without words have no windows and no hits; an item of fewer words than a window is
one window; a null item_id marks words but is not counted or listed; item_ids that repeat count once; repeated
documents are judged row by row; a text of more words than a shard is a shard of its own; an empty benchmark leaves
all clean; no documents give no rows; further columns are not read, or pass through.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class BitRank:
    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, np.uint8)
        self.words = np.packbits(np.concatenate([bits, pad]), bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, now = [], symbols
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = (now >> shift & 1).astype(bool)
            self.levels.append((shift, BitRank(one)))
            now = np.concatenate([now[~one], now[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place."""
        start, place = np.zeros_like(at), at
        for shift, level in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            s1, p1 = level.ones(start), level.ones(place)
            start, place = np.where(one, level.zeros + s1, start - s1), np.where(one, level.zeros + p1, place - p1)
        return place - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out, place = np.zeros_like(at), at
        for shift, level in self.levels:
            one, p1 = level.get(place), level.ones(place)
            out |= one.astype(out.dtype) << shift
            place = np.where(one, level.zeros + p1, place - p1)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of word numbers from 1 and end marks 0, of which the last is one.

    End marks differ, in order of place, so no suffix is compared beyond its own. Suffixes are sorted by their first
    words; then, depth doubling, those that are still tied are sorted by the rank of what follows.
    """
    n, marks = len(text), np.cumsum(text == 0)
    symbol = np.where(text == 0, marks - 1, text + int(marks[-1])).astype(np.int64)
    base = int(symbol.max()) + 2
    depth = 3 if base < 1 << 21 else 2
    key = symbol.copy()
    for k in range(1, depth):
        key *= base
        key[: n - k] += symbol[k:] + 1
    order = np.argsort(key)
    head = np.r_[True, np.diff(key[order]) != 0]
    rank = np.empty(n, np.int64)
    # a rank is the first place of its group of tied suffixes
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    at = np.flatnonzero(~(head & np.r_[head[1:], True]))
    while at.size:
        tied = order[at]
        key = rank[tied] * (n + 1) + rank[tied + depth]
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        order[at] = tied
        head = np.r_[True, np.diff(key) != 0]
        rank[tied] = at[np.flatnonzero(head)][np.cumsum(head) - 1]
        at = at[~(head & np.r_[head[1:], True])]
        depth *= 2
    return order


class FMIndex:
    """text: word numbers from 1, end marks 0; the last is an end mark."""

    def __init__(self, text: np.ndarray, top: int, sample: int = 16):
        order = suffix_array(text)
        last = text[order - 1]
        self.wavelet = WaveletMatrix(last.astype(np.int32), top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 2))])
        self.sampled = (order % sample == 0) | (last == 0)
        self.places = np.where(self.sampled, order, -1)

    def search(self, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of words."""
        lo = np.zeros(len(pattern), np.int64)
        hi = np.full(len(pattern), len(self.places), np.int64)
        live = np.arange(len(pattern))
        for k in range(pattern.shape[1] - 1, -1, -1):
            c = pattern[live, k]
            lo[live], hi[live] = self.first[c] + self.wavelet.rank(c, lo[live]), self.first[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi[lo > hi] = lo[lo > hi]
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, walk, live = np.empty(len(row), np.int64), row.copy(), np.arange(len(row))
        steps = 0
        while live.size:
            done = self.sampled[walk[live]]
            out[live[done]] = self.places[walk[live[done]]] + steps
            live = live[~done]
            at = walk[live]
            c = self.wavelet.access(at)
            walk[live] = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


class Block:
    """Windows of some items: their words, the windows by numbers of words, and the items of each window."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        vocab: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, words in items:
            ids = tuple(vocab.setdefault(w, len(vocab)) for w in words)
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                owners.setdefault(ids[i : i + window], set()).add(item)
        self.words = list(vocab)
        self.groups = []
        for n in sorted({len(k) for k in owners}):
            keys = [k for k in owners if len(k) == n]
            self.groups.append((n, np.array(keys, np.int32), [sorted(x for x in owners[k] if x is not None) for k in keys]))


def benchmark_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """Broadcasts of the benchmark, block by block; the driver builds one block at a time."""
    sc, out, part, held = items.sparkSession.sparkContext, [], [], 0
    for r in items.select(F.col(id_col), F.col(text_col).cast("string")).toLocalIterator():
        words = words_of(r[1])
        if words:
            part.append((r[0], words))
            held += len(r[1])
        if held >= block_bytes:
            out.append(sc.broadcast(Block(part, window)))
            part, held = [], 0
    if part:
        out.append(sc.broadcast(Block(part, window)))
    return out


#: Blocks that a worker keeps in memory.
_HELD = 8
_held: OrderedDict = OrderedDict()


def _block(sent: Broadcast) -> Block:
    """A broadcast's block; the worker keeps the last ones and reads others from its disk again."""
    if sent._path not in _held:
        _held[sent._path] = sent.value
        sent.__dict__.pop("_value", None)
        while len(_held) > _HELD:
            _held.popitem(last=False)
    _held.move_to_end(sent._path)
    return _held[sent._path]


class Shard:
    """The FM-index of some documents' words, and which document and word stands at each place."""

    def __init__(self, docs: list[list[bytes]]):
        self.vocab: defaultdict = defaultdict(count(1).__next__)
        size = np.array([len(d) for d in docs], np.int64)
        parts = []
        for words in docs:
            parts += [np.fromiter(map(self.vocab.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        self.first = np.cumsum(size + 1) - size - 1
        self.index = FMIndex(np.concatenate(parts), len(self.vocab))

    def find(self, block: Block):
        """For each length of windows: the length, and each occurrence's window, document and place, in order of documents."""
        number = np.array([self.vocab.get(w, 0) for w in block.words], np.int64)
        for n, windows, owners in block.groups:
            pattern = number[windows]
            known = np.flatnonzero((pattern > 0).all(axis=1))  # a word that the shard has not has no range
            lo, hi = self.index.search(pattern[known])
            hit = np.flatnonzero(hi > lo)
            if not hit.size:
                continue
            size = (hi - lo)[hit]
            rows = np.repeat(lo[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())
            place = np.sort(self.index.locate(rows) * len(windows) + np.repeat(known[hit], size))
            place, which = np.divmod(place, len(windows))
            doc = np.searchsorted(self.first, place, side="right") - 1
            yield n, owners, which, doc, place - self.first[doc]


def search_shard(docs: list[list[bytes]], blocks) -> tuple[list[np.ndarray], list[set]]:
    """For each document the merged spans of hit words (rows of start and end), and the items that occur."""
    marks: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in docs]
    items: list[set] = [set() for _ in docs]
    if any(docs):
        shard = Shard(docs)
        for block in blocks:
            for n, owners, which, doc, at in shard.find(block):
                cut = np.flatnonzero(np.r_[True, np.diff(doc) != 0, True])
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    own = int(doc[a])
                    marks[own].append((at[a:b], at[a:b] + n))
                    for w in np.unique(which[a:b]).tolist():
                        items[own].update(owners[w])
    spans = []
    for found in marks:
        if not found:
            spans.append(np.zeros((0, 2), np.int64))
            continue
        a, b = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        new = np.r_[True, a[1:] > b[:-1]]
        spans.append(np.stack([a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]], axis=1))
    return spans, items


def _shards(batches, text_at: int, shard_words: int):
    """Batches cut so that each has about shard_words words, with the words of each row."""
    for b in batches:
        words, start, held = [], 0, 0
        for i in range(b.num_rows):
            words.append(words_of(b.column(text_at)[i].as_py()))
            held += len(words[-1])
            if held >= shard_words or i == b.num_rows - 1:
                yield b.slice(start, i + 1 - start), words
                words, start, held = [], i + 1, 0


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = 10, shard_words: int = 400_000, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every row; no shuffle. spans: flat starts and ends of hit words."""
    blocks = benchmark_blocks(items, item_col, item_text, window, block_bytes)

    def run(batches):
        for b, words in _shards(batches, 1, shard_words):
            spans, found = search_shard(words, map(_block, blocks))
            hit = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
            names = [",".join(sorted(map(str, f))) for f in found]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_words": pa.array(list(map(len, words)), pa.int64()), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array(list(map(len, found)), pa.int64()), "items_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names], pa.string()), "contaminated": pa.array([h > 0 for h in hit], pa.bool_()), "spans": pa.array([s.ravel().tolist() for s in spans], pa.list_(pa.int64()))})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(giving_back(run), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<long>")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = 10, shard_words: int = 400_000, block_bytes: int = 1 << 20) -> DataFrame:
    """The rows without a hit. All columns pass through."""
    blocks = benchmark_blocks(items, item_col, item_text, window, block_bytes)
    place = docs.columns.index(text_col)

    def run(batches):
        for b, words in _shards(batches, place, shard_words):
            spans, _ = search_shard(words, map(_block, blocks))
            yield b.filter(pa.array([not len(s) for s in spans], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")
