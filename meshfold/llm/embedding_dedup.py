"""Embedding near-duplicates with a pivot-permutation index.

Each vector is described by the ordered list of its `nearest` nearest pivots (reference points). A pivot is shared by
two vectors if both lists have it, at places that differ by at most `slack`. Two vectors with at least `shared`
pivots in common are verified by cosine in double precision.

The index has an inverted list for each pivot. If two lists of k pivots have s in common then, in any one order of all
pivots, their first k - s + 1 have one in common; so a vector stands only in the lists of its k - s + 1 rarest pivots. In
a list the shared pivots of its pairs are counted; a pair that meets in several lists counts in that of the rarest.
Lists of more than `cap` vectors meet block by block. Tasks give counts per vector and a spanning star of links, never
pairs. The number of pivots grows with the square root of the number of vectors, `density` times it, so that lists do too.

The pivots come from a bounded sample; every vector is indexed. Retrieval is approximate: a link is lost if the two
share too few pivots. Vectors of a length with fewer than 4 * `nearest` pivots share one list, which is exact.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths are in different spaces; repeated rows are linked with each other; a null id has a row and is
never a component's id unless all ids of the component are null; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, giving_back, materialize
from .components import local_roots, stars
from .simhash import dealt, group_numbers, whole_groups

MOST_PIVOTS = 65_536


def _unit(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / top
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the nearest pivots of each row, the nearest first; of equally near ones the first."""
    near = unit @ pivots.T
    some = np.sort(np.argpartition(-near, nearest - 1, axis=1)[:, :nearest], axis=1)
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def sample_pivots(nodes: DataFrame, count: int, apart: float, least: int) -> dict[int, np.ndarray]:
    """Pivots for each vector length, from the 8 * count nodes with the least hash.

    Pivots lie apart (cosine below `apart`): the members of a dense group would have too many, about equally near
    pivots if some were its own members. Where fewer than `least` lie apart, others of the sample fill up.
    """
    rows = nodes.select("vec", F.size("vec").alias("dim"), F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(8 * count)
    found: dict[int, list] = {}
    rest: dict[int, list] = {}
    for r in rows.toLocalIterator():
        own = found.setdefault(r["dim"], [])
        x = _unit(np.array([r["vec"]], dtype=float))[0]
        if len(own) < count and (not own or (np.array(own) @ x).max() < apart):
            own.append(x)
        elif len(rest.setdefault(r["dim"], [])) < least:
            rest[r["dim"]].append(x)
    filled = {d: v if len(v) >= least else (v + rest.get(d, []))[:least] for d, v in found.items()}
    return {d: np.array(v) for d, v in filled.items() if len(v) >= least}


def shared_pivots(a: np.ndarray, b: np.ndarray, slack: int) -> np.ndarray:
    """For rows of ordered pivots, how many each row of a shares with each of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for i in range(a.shape[1]):
        for j in range(max(0, i - slack), min(b.shape[1], i + slack + 1)):
            out += a[:, i, None] == b[None, :, j]
    return out


def meets_before(a: np.ndarray, b: np.ndarray, own: int) -> np.ndarray:
    """Of rows of ascending ranks, which pairs have a rank below `own` in common."""
    out = np.zeros((len(a), len(b)), bool)
    for i in range(a.shape[1]):
        x = np.where(a[:, i] < own, a[:, i], -1)
        for j in range(b.shape[1]):
            out |= x[:, None] == b[None, :, j]
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, least: float = 0.95, density: float = 4.0, nearest: int = 8, shared: int = 4, slack: int = 5, cap: int = 2048, apart: float = 0.7) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, F.transform(x, lambda v: v + F.lit(0.0))).alias("vec"))
    nodes = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("many"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    spark = nodes.sparkSession
    count = int(min(MOST_PIVOTS, max(4 * nearest, density * nodes.count() ** 0.5)))
    sent = spark.sparkContext.broadcast(sample_pivots(nodes, count, apart, 4 * nearest))
    prefix = nearest - shared + 1

    def describe(batches):
        for b in batches:
            node, vec = b.column(0).to_numpy(), b.column(1)
            dims = np.diff(vec.offsets.to_numpy())
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                p = sent.value.get(d)
                for part in np.array_split(at, len(at) // 1024 + 1):
                    near = np.zeros((len(part), 0), np.int32) if p is None else nearest_pivots(_unit(_matrix(vec.take(pa.array(part)))), p, nearest).astype(np.int32)
                    offsets = np.arange(len(part) + 1, dtype=np.int32) * near.shape[1]
                    yield pa.RecordBatch.from_pydict({"node": pa.array(node[part]), "dim": pa.array(np.full(len(part), d, np.int32)), "pivots": pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel()))})

    described = materialize(nodes.select("node", "vec").mapInArrow(giving_back(describe), "node long, dim int, pivots array<int>"), "permutations")
    # as many rows as there are pivots
    often = described.select("dim", F.explode("pivots").alias("p")).groupBy("dim", "p").agg(F.count("*").alias("n")).collect()
    ranks = {d: np.full(len(p), -1, np.int32) for d, p in sent.value.items()}
    for at, r in enumerate(sorted(often, key=lambda r: (r["n"], r["p"]))):
        ranks[r["dim"]][r["p"]] = at
    order_of = spark.sparkContext.broadcast(ranks)

    def post(batches):
        for b in batches:
            node, dim, pivots = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                key = np.full((len(at), 1), -1, np.int32)
                if d in order_of.value:
                    key = np.sort(order_of.value[d][_matrix(pivots.take(pa.array(at))).astype(np.int64)], axis=1)[:, :prefix]
                yield pa.RecordBatch.from_pydict({"dim": pa.array(np.repeat(np.int32(d), key.size)), "rank": pa.array(key.ravel()), "node": pa.array(np.repeat(node[at], key.shape[1]))})

    lists = materialize(described.mapInArrow(giving_back(post), "dim int, rank int, node long"), "pivot-lists")
    # lists of one vector hold no pair
    full = lists.join(lists.groupBy("dim", "rank").agg(F.count("*").alias("c")).where("c > 1").select("dim", "rank"), ["dim", "rank"], "left_semi")
    marks = materialize(nodes.select("node", "many", "vec").join(described.select("node", "pivots"), "node"), "described-vectors")
    full = dealt(full, ["dim", "rank"], F.xxhash64("node"), cap).join(marks, "node")
    order = ["dim", "rank", "lo", "hi"]

    def link(batches):
        for t in whole_groups(batches, order, 10_000):
            number = group_numbers(t, order)
            dim, rank, lo, hi, own, node, many = (t[c].to_numpy() for c in (*order, "own", "node", "many"))
            vec, pivots = (t[c].combine_chunks() for c in ("vec", "pivots"))
            cut = np.flatnonzero(np.r_[True, np.diff(number) > 0, True])
            links, a, b = np.zeros(len(node), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if e - s < 2:
                    continue
                unit = _unit(_matrix(vec.slice(s, e - s)))
                some = rank[s] >= 0
                if some:
                    near_by = _matrix(pivots.slice(s, e - s)).astype(np.int32)
                    first = np.sort(order_of.value[int(dim[s])][near_by], axis=1)[:, :prefix]
                for at in range(0, e - s, 1024):
                    i = slice(at, min(at + 1024, e - s))
                    near = np.arange(e - s)[i][:, None] != np.arange(e - s)
                    if some:
                        near &= shared_pivots(near_by[i], near_by, slack) >= shared
                    near &= unit[i] @ unit.T >= least
                    if lo[s] != hi[s]:
                        near &= own[s:e][i][:, None] != own[s:e][None, :]
                    if some and near.any():
                        near &= ~meets_before(first[i], first, int(rank[s]))
                    links[s:e][i] += near @ many[s:e]
                    r, c = np.nonzero(near)
                    if len(r):
                        x, y = local_roots(r + at, c)
                        a.append(node[s + x])
                        b.append(node[s + y])
            some = np.flatnonzero(links)
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.r_[node[some], a]), "b": pa.array(np.r_[node[some], b]), "n": pa.array(np.r_[links[some], np.zeros(len(a), np.int64)])})

    found = materialize(full.select(*order, "own", "node", "many", "pivots", "vec").repartition(*order).sortWithinPartitions(*order).mapInArrow(giving_back(link), "a long, b long, n long"), "vector-links")
    for used in (described, lists, marks):
        discard(used)
    roots = stars(found.where("a <> b").select("a", "b"))
    links = materialize(found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node"), "link-counts")
    named = materialize(nodes.select("node", "low", "many", "vec").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node")), "named-vectors")
    lows = materialize(named.groupBy("root").agg(F.min("low").alias("component_id")), "component-ids")
    # written, so that a vector that many rows have can be split at run time
    named = materialize(named.join(lows, "root").select(F.col("vec").alias("same"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id"), "vector-classes")
    whole = rows.join(named, F.col("vec") == F.col("same"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return whole.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
