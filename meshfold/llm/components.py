"""Connected components: contraction within tasks, and alternating stars between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, giving_back, materialize

#: Edges that a task contracts at a time.
TASK_EDGES = 1 << 18


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each component of the edges (a, b): nodes and their least node, roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    p = np.arange(len(nodes))
    while len(x) and (p[x] != p[y]).any():
        low = np.minimum(p[x], p[y])
        np.minimum.at(p, p[x], low)
        np.minimum.at(p, p[y], low)
        while (p != p[p]).any():
            p = p[p]
    own = p != np.arange(len(nodes))
    return nodes[own], nodes[p[own]]


def _large_star(edges: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v), u > v: each node's larger neighbours move to the least node that it sees, itself included."""
    seen = edges.union(edges.select("v", "u"))
    # written, so that both sides of the join are plain exchanges, of which a hub's share can be split at run time
    least = materialize(seen.groupBy("u").agg(F.min("v").alias("m")), "least", plain=True, rows=rows)
    return materialize(seen.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "edges", plain=True, rows=rows), least


def _small_star(edges: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Each node's smaller neighbours, and itself, move to the least of them."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least", plain=True, rows=rows)
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", plain=True, rows=rows), least


def _contracted(edges: DataFrame, block: int) -> DataFrame:
    """Edges (u, v), u > v, of the same components: of what a task reads, block by block, only spanning stars stay."""

    def run(batches):
        u, v = np.zeros((2, 0), np.int64)
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= block:
                u, v = local_roots(*(np.concatenate([x, *(b.column(k).to_numpy() for b in held)]) for k, x in enumerate((u, v))))
                held, rows = [], 0
                if len(u) > block:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    u, v = np.zeros((2, 0), np.int64)
        u, v = local_roots(*(np.concatenate([x, *(b.column(k).to_numpy() for b in held)]) for k, x in enumerate((u, v))))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.mapInArrow(giving_back(run), "u long, v long")


def stars(edges: DataFrame, a: str = "a", b: str = "b", *, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root), a written table, for each node of an edge but the roots: root is the least node of its component.

    In each round tasks first contract the edges that they read to spanning stars; if one task reads them all, that is
    the result. If not, a large-star and a small-star step follow, each written to the shared folder, until the edges
    no longer change; the number of rounds grows with the logarithm of the component's diameter. A round's tables
    are deleted once the next one is written.

    Cases: edges from a node to itself and repeated edges do not matter; edges with a null end are left out; no
    edges give no rows; further columns are not read.
    """
    now = materialize(_contracted(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y")).where("u > v and not x and not y").select("u", "v"), task_edges), "edges", plain=True)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        tasks = seen[0] // task_edges + 1
        used = [now]
        now = materialize(_contracted(now.coalesce(tasks), task_edges), "edges", plain=True)
        if tasks > 1:
            for step in (_large_star, _small_star):
                used.append(now)
                now, least = step(now, seen[0])
                used.append(least)
        for table in used:
            discard(table)
        if tasks == 1:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.written_to = now.written_to
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The stars of the edges with the roots themselves, as their own roots."""
    found = stars(edges, a, b)
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())
