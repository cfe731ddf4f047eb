"""Best-fit packing of token pieces into fixed-length sequences under several capacities.

A bin has a residual of tokens, of documents and of attention cost (sum of squared piece lengths). Pieces go,
largest first, to the bin that fits under every capacity and has the least weighted residual norm afterwards
(rule "norm", which for tokens alone is best-fit decreasing) or the largest weighted dot product of piece and
residual (rule "dot"); if none fits, a new bin opens. Groups of pieces are packed side by side, each as large
as `group` pieces, so at most one bin of a group stays far from full: its share falls with the group's size.

Cases: a null or empty text is one piece, the end id; repeated rows are pieces of their own; a null id is kept;
an empty table gives no rows; only a document longer than the token capacity is cut.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, materialize
from .tokens import encoder, parts_of

PART_BYTES = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(items: np.ndarray, caps: np.ndarray, weights: np.ndarray, rule: str = "norm", block: int = 512) -> np.ndarray:
    """The bin of each item. items: n rows of sizes, one column for each capacity. Ties go to the oldest bin.

    Items go in blocks; only bins with room for the smallest sizes of a block are looked at for its items, and bins
    without room for anything still to come are closed.
    """
    n = len(items)
    bins = np.empty(n, np.int64)
    if not n:
        return bins
    if (items > caps).any():
        raise ValueError("a piece is larger than a bin")
    live = np.isfinite(caps)
    sizes = items[:, live] / caps[live]
    w = weights[live]
    order = np.argsort(-(sizes * w).sum(1), kind="stable")
    least = np.minimum.accumulate(sizes[order][::-1], axis=0)[::-1]  # the smallest of what is still to come
    dims, made, eps = sizes.shape[1], 0, 1e-12
    all_room, all_name = np.empty((0, dims)), np.empty(0, np.int64)
    for start in range(0, n, block):
        part = order[start : start + block]
        open_ = (all_room + eps >= least[start]).all(1)
        all_room, all_name = all_room[open_], all_name[open_]
        now = (all_room + eps >= sizes[part].min(0)).all(1)
        used = int(now.sum())
        room = np.empty((dims, used + len(part)))  # one row for each capacity
        name = np.empty(used + len(part), np.int64)
        room[:, :used], name[:used] = all_room[now].T, all_name[now]
        for i in part:
            x = sizes[i]
            fit = np.flatnonzero(room[0, :used] >= x[0] - eps)
            for d in range(1, dims):
                fit = fit[room[d, fit] >= x[d] - eps]
            if fit.size:
                r = room[:, fit]
                left = r - x[:, None]
                b = int(fit[(w @ (left * left) if rule == "norm" else -(w * x) @ r).argmin()])
                room[:, b] -= x
            else:
                b, room[:, used], name[used] = used, 1.0 - x, made
                used, made = used + 1, made + 1
            bins[i] = name[b]
        all_room = np.concatenate([all_room[~now], room[:, :used].T])
        all_name = np.concatenate([all_name[~now], name[:used]])
        by_age = np.argsort(all_name)
        all_room, all_name = all_room[by_age], all_name[by_age]
    return bins


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    def cut(batches):
        enc = encoder(tokenizer)
        for b in (p for batch in batches for p in parts_of(batch, 1, PART_BYTES)):
            rows = []
            flat, at = enc.ids(b.column(1))
            for key, i, j in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                ids = np.append(flat[i:j], end_id).astype("<u4")
                rows += [(key, k, s, len(x), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, len(ids), capacity)) if len(x := ids[s : s + capacity])]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(giving_back(cut, encoder), PIECES)


def pack(pieces: DataFrame, *, capacity: int = 2048, max_docs: float = 2048, max_attention: float = 2048 * 2048, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm", group: int = 40_000) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (dealing it out by rows must be repeatable)."""
    n = max(1, math.ceil(pieces.count() / group))

    def fill(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        length = t["length"].to_numpy().astype(np.int64)
        items = np.stack([length, np.ones_like(length), length * length], axis=1).astype(float)
        bins = best_fit(items, np.array([capacity, max_docs, max_attention], float), np.array(weights), rule)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        first = np.r_[True, np.diff(bins[order]) > 0]
        base = np.repeat((ends - length[order])[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
        offset = np.empty_like(length)
        offset[order] = ends - length[order] - base
        t = t.append_column("sequence_id", pa.array(bins + (TaskContext.get().partitionId() << 32))).append_column("offset", pa.array(offset))
        yield from t.to_batches(max_chunksize=20_000)

    return pieces.repartition(n).mapInArrow(giving_back(fill), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, **kw) -> DataFrame:
    return pack(materialize(token_pieces(docs), "pieces"), **kw)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
