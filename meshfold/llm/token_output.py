"""Token-ID / binary output: raw id shards with a minimal perfect hash index.

A shard holds the ids of a run of documents in ascending key order. Its index maps a document key, through a
multi-level minimal perfect hash, to a slot with a 16-bit fingerprint of the key and the entry it stands for.
Keyed access costs a constant expected number of hash probes; no key is searched for.

Layout (little-endian): magic, raw ids, index arrays, JSON footer, its length as u8, magic.

Cases: a null or empty text holds only the end id; rows that repeat a key are separate, adjacent entries and
keyed access gives all of them; a null key is stored first and is not indexed; an empty table gives no shard.
Only the two named columns are read, so further columns, whatever their names, do not matter.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, giving_back, planned_bytes, shuffle_partitions
from .tokens import encoder, parts_of

MAGIC = b"MFTOKEN1"
GAMMA = 2.0
PART_BYTES = 4 << 20


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of key and seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level the keys that are alone in their cell settle there."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        rest, sizes, words = keys.astype(np.uint64), [], []
        while rest.size:
            size = (int(rest.size * GAMMA) // 64 + 1) * 64
            cell = (_mix(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            count = np.bincount(cell, minlength=size)
            sizes.append(size)
            words.append(np.packbits(count == 1, bitorder="little").view("<u8"))
            rest = rest[count[cell] > 1]
        words = np.concatenate(words) if words else np.zeros(0, "<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return cls(np.array(sizes, "<i8"), words, ranks.astype("<i8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level holds it."""
        keys = keys.astype(np.uint64)
        out, open_, base = np.full(keys.size, -1, np.int64), np.arange(keys.size), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not open_.size:
                break
            cell = (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.words[cell >> 6], (cell & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.ranks[cell >> 6] + below)[hit]
            open_, base = open_[~hit], base + size
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.uint64), 1 << 20) >> np.uint64(48)).astype("<u2")


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, uri: str, dtype: str):
        self.uri, self.dtype = uri, dtype
        fs, path = _filesystem(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.keys: list[int | None] = []
        self.ends = [0]

    def add(self, key: int | None, raw: bytes) -> None:
        self.out.write(raw)
        self.keys.append(key)
        self.ends.append(self.ends[-1] + len(raw) // int(self.dtype[-1]))

    def close(self) -> int:
        """Write the index; the number of ids."""
        null = np.array([k is None for k in self.keys], dtype=bool)
        keys = np.array([k or 0 for k in self.keys], dtype="<i8")
        known = np.flatnonzero(~null)
        order = known[np.argsort(keys[known], kind="stable")]
        unique, first, reps = np.unique(keys[order], return_index=True, return_counts=True)
        mph = PerfectHash.build(unique.view(np.uint64))
        slot = mph.slots(unique.view(np.uint64))
        prints, entry, many = (np.zeros(unique.size, t) for t in ("<u2", "<i8", "<i8"))
        prints[slot], entry[slot], many[slot] = fingerprints(unique.view(np.uint64)), first, reps
        arrays = {"keys": keys, "null": null.astype("<u1"), "ends": np.array(self.ends, "<i8"), "order": order.astype("<i8"), "sizes": mph.sizes, "words": mph.words.astype("<u8"), "ranks": mph.ranks, "prints": prints, "entry": entry, "many": many}
        at, where = len(MAGIC) + self.ends[-1] * int(self.dtype[-1]), {}
        for name, a in arrays.items():
            where[name] = [at, a.dtype.str, a.size]
            self.out.write(a.tobytes())
            at += a.nbytes
        footer = json.dumps({"dtype": self.dtype, "docs": len(self.keys), "ids": self.ends[-1], "arrays": where}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.ends[-1]


class ShardReader:
    """Keyed access to one shard; ids are read from the file by offset."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        n = int.from_bytes(tail[:8], "little")
        meta = json.loads(self.file.read_at(n, size - 16 - n))
        self.dtype, self.docs, self.ids = meta["dtype"], meta["docs"], meta["ids"]
        self.a = {k: np.frombuffer(self.file.read_at(np.dtype(t).itemsize * m, at), t) for k, (at, t, m) in meta["arrays"].items()}
        self.mph = PerfectHash(self.a["sizes"], self.a["words"], self.a["ranks"])

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The entries of each key, none for a key whose fingerprint differs."""
        keys = np.asarray(keys, dtype="<i8").view(np.uint64)
        slot = self.mph.slots(keys)
        ok = (slot >= 0) & (slot < self.a["prints"].size)
        ok[ok] = self.a["prints"][slot[ok]] == fingerprints(keys[ok])
        none = np.zeros(0, np.int64)
        return [self.a["order"][self.a["entry"][s] : self.a["entry"][s] + self.a["many"][s]] if k else none for s, k in zip(slot.tolist(), ok.tolist())]

    def read(self, entry: int) -> np.ndarray:
        a, b = self.a["ends"][entry : entry + 2].tolist()
        w = int(self.dtype[-1])
        return np.frombuffer(self.file.read_at((b - a) * w, len(MAGIC) + a * w), self.dtype)


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, n_shards: int | None = None, shard_bytes: int = 1 << 30, out: str | None = None) -> DataFrame:
    """Write token shards in ascending key order; the manifest (shard, uri, n_docs, n_ids, start).

    There are as many shards as shuffle partitions, and more where the input is larger than that many times
    `shard_bytes`. Keys are dealt by range, rows of one key by a hash of the text, so the order holds across shards and a
    key that many rows have is no single task. A task streams its rows to one file named by a
    fresh id; only files of tasks that ended stand in the manifest, so a retry leaves at most an unused file.
    """
    spark = docs.sparkSession
    n = n_shards or max(shuffle_partitions(spark), planned_bytes(docs) // shard_bytes)
    out = out or fresh_path(spark, "token-shards")

    def write(batches):
        enc = encoder(tokenizer)
        end, writer = enc.pack([end_id]), None
        for batch in batches:
            for b in parts_of(batch, 1, PART_BYTES):
                writer = writer or ShardWriter(f"{out}/{uuid.uuid4().hex}.ids", enc.dtype)
                ids, at = enc.ids(b.column(1))
                for key, i, j in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    writer.add(key, ids[i:j].tobytes() + end)
        if writer:
            ids = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "uri": [writer.uri], "n_docs": [len(writer.keys)], "n_ids": [ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t")).repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h").select("k", "t")
    # one row per shard, whatever the number of documents
    made = sorted(rows.mapInArrow(giving_back(write, encoder), "shard int, uri string, n_docs long, n_ids long").collect())
    starts = np.cumsum([0, *(r["n_ids"] for r in made)]).tolist()
    return spark.createDataFrame([(*r, start) for r, start in zip(made, starts)], "shard int, uri string, n_docs long, n_ids long, start long")


def read_shards(manifest: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """Every document of the shards, found by its key through the index: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = ShardReader(uri)
                null = np.flatnonzero(shard.a["null"])
                keys = np.unique(shard.a["keys"][shard.a["null"] == 0])
                found = shard.find(keys)
                for at in range(0, max(len(keys), 1), 1024):
                    own = [(int(k), int(e)) for k, es in zip(keys[at : at + 1024], found[at : at + 1024]) for e in es] + ([(None, int(e)) for e in null] if at == 0 else [])
                    ids = [shard.read(e) for _, e in own]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in own], pa.int64()), "start": pa.array([start + int(shard.a["ends"][e]) for _, e in own], pa.int64()), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())})

    n = n_tasks or shuffle_partitions(manifest.sparkSession)
    return manifest.select("uri", "start").repartition(n).mapInArrow(giving_back(read, encoder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
