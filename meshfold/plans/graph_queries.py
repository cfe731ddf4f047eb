"""Queries over the test graph: all vertices of `embeddings` with all 64 components, all edges of `lineitem`.

Where the feature is a frontier that shrinks, the edges are those with s < t, as otherwise every vertex stays active.
Matrices follow plain formulas, so SQL can state them; they are divided by 32, which keeps states near 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import fresh_folder
from ..operators import partitioning as P
from ..operators import statistics as S
from ..operators import superstep as M
from ..operators import training as T
from ..sources import checkpoints
from ..sources import graphs as G

DIM, CLASSES, RANKS = 64, 10, 4


def weight(layer: int) -> np.ndarray:
    return np.array([[((1.0 if i == j else 0.0) + ((i * 13 + j * 7 + layer * 5) % 11 - 5) / 20) / 32 for j in range(DIM)] for i in range(DIM)])


def bias(layer: int) -> np.ndarray:
    return np.array([((i * 3 + layer) % 5 - 2) / 50 for i in range(DIM)])


def model(depth: int = 2) -> T.Model:
    head = np.array([[((c * 31 + d * 17) % 13 - 6) / 100 for d in range(DIM)] for c in range(CLASSES)])
    return T.Model([(weight(k), bias(k)) for k in range(depth)], (head, np.zeros(CLASSES)))


IDENTITY = (np.eye(DIM), np.zeros(DIM))


def dag(spark, sf):
    return G.from_tables(spark, sf, dim=DIM, dag=True)


def dense(spark, sf):
    return G.from_tables(spark, sf, dim=DIM)


def long(df: DataFrame, key: list[str], vec: str, at: str = "d", value: str = "x", digits: int = 6) -> DataFrame:
    """One row for each component; -0.0 becomes 0.0."""
    return df.select(*key, F.posexplode(vec).alias(at, "_x")).select(*key, F.col(at).cast("int").alias(at), (F.round("_x", digits) + F.lit(0.0)).alias(value))


def matrix(spark, m: np.ndarray, value: str = "g", digits: int = 8) -> DataFrame:
    rows = [(i, j, float(round(x, digits)) + 0.0) for i, r in enumerate(np.atleast_2d(m)) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, f"i int, j int, {value} double").select("i", "j", (F.round(value, digits) + F.lit(0.0)).alias(value))


def layers(g, depth=2, plain=False):
    return M.forward(g.edges, M.initial_state(g.nodes), [IDENTITY] * depth if plain else model(depth).layers)


def labels(g):
    return g.nodes.select("v", "label", "is_train", "is_val", "is_test")


def starts(g, kind="edge", edges=None):
    if kind == "vertex":
        return P.vertex_ranges(g.n, RANKS)
    return P.cost_ranges(P.degrees(g.edges, g.n), g.n, RANKS, None if kind == "edge" else 10.0)


# ---- queries


def dataset_summary(spark, sf):
    return G.summary(G.from_tables(spark, sf))


def first_labels(spark, sf):
    return dense(spark, sf).nodes.select("v", "label").orderBy("v").limit(5)


def split_counts(spark, sf):
    split = F.when(F.col("is_train"), "train").when(F.col("is_val"), "val").otherwise("test")
    return dense(spark, sf).nodes.groupBy(split.alias("split")).agg(F.count("*").alias("n"))


def label_histogram(spark, sf):
    return dense(spark, sf).nodes.groupBy("label").agg(F.count("*").alias("n"))


def induced_subgraph(spark, sf):
    g = dense(spark, sf)
    return G.induced(g.edges, g.n // 2).groupBy("s", "t").agg(F.count("*").alias("k"))


def node_fraction(spark, sf):
    g = dense(spark, sf)
    return g.nodes.where(F.col("v") < G.node_limit(g.n, 0.3, 120)).select("v", "label")


def out_degree(spark, sf):
    g = dense(spark, sf)
    return P.degrees(g.edges, g.n)


def in_degree(spark, sf):
    g = dense(spark, sf)
    return P.degrees(g.edges, g.n, "t")


def _listed(df, *cols):
    return df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if c in ("neighbours", "sources") else c for c in cols])


def adjacency_csr(spark, sf):
    g = dense(spark, sf)
    return _listed(P.adjacency(g.edges, g.n), "v", "row_start", "neighbours")


def reverse_csr(spark, sf):
    g = dense(spark, sf)
    return _listed(P.reverse_adjacency(g.edges, g.n, starts(g, "vertex")), "v", "row_start", "neighbours")


def _ranges(kind):
    def query(spark, sf):
        return P.ranges_frame(spark, starts(dense(spark, sf), kind))

    return query


def _stats(kind):
    def query(spark, sf):
        g = dense(spark, sf)
        return P.partition_stats(P.degrees(g.edges, g.n), starts(g, kind))

    return query


def owner_local_id(spark, sf):
    g = dense(spark, sf)
    return P.local_ids(g.nodes.select("v"), starts(g))


def load_balance(spark, sf):
    g = dense(spark, sf)
    return S.load_balance(P.degrees(g.edges, g.n), starts(g, "vertex"))


def message_volume(spark, sf):
    g = dense(spark, sf)
    return S.message_volume(g.edges, starts(g), DIM)


def memory_estimate(spark, sf):
    g = dense(spark, sf)
    return S.memory_estimate(P.degrees(g.edges, g.n), starts(g), DIM)


def edge_owner_counts(spark, sf):
    g = dense(spark, sf)
    return P.crossing(g.edges, starts(g)).groupBy("s_rank", "t_rank").agg(F.count("*").alias("n"))


def seed_gather(spark, sf):
    g = dense(spark, sf)
    return long(M.gather(g.edges, M.initial_state(g.nodes), DIM), ["v", "received"], "aggr")


def superstep_identity(spark, sf):
    g = dag(spark, sf)
    return long(M.superstep(g.edges, M.initial_state(g.nodes), *IDENTITY), ["v", "active"], "h")


def superstep_linear(spark, sf):
    g = dense(spark, sf)
    return long(M.superstep(g.edges, M.initial_state(g.nodes), weight(0), bias(0)), ["v", "active"], "h")


def _forward(depth):
    def query(spark, sf):
        return long(layers(dag(spark, sf), depth)[-1], ["v", "active"], "h", digits=4)

    return query


def ramp_forward(spark, sf):
    g = dag(spark, sf)
    return long(M.forward(g.edges, M.ramp_state(g.nodes.select("v"), g.n, DIM), [IDENTITY] * 2)[-1], ["v", "active"], "h")


def frontier_by_layer(spark, sf):
    rows = [x.where("active").select(F.lit(k).alias("layer"), "v") for k, x in enumerate(layers(dag(spark, sf), 3, True))]
    return rows[0].union(rows[1]).union(rows[2])


def layer_profile(spark, sf):
    g = dag(spark, sf)
    return M.layer_profile(g.edges, layers(g, 3, True), starts(g))


def passthrough_vertices(spark, sf):
    last = layers(dag(spark, sf), 2)[-1]
    return long(last.where("not active"), ["v"], "h")


def stale_aggregates(spark, sf):
    return long(M.stale_aggregates(layers(dag(spark, sf), 2, True), DIM), ["v"], "aggr")


def contributor_trace(spark, sf):
    g = dag(spark, sf)
    return _listed(M.contributor_trace(g.edges, layers(g, 1, True)[0], starts(g)), "v", "sources")


def rank_groups(spark, sf):
    g = dense(spark, sf)
    return _listed(P.rank_groups(g.edges, starts(g)), "t", "s_rank", "sources", "n")


def batching_ratio(spark, sf):
    g = dense(spark, sf)
    return P.rank_groups(g.edges, starts(g)).agg(F.sum("n").alias("pairs"), F.count("*").alias("groups"), F.round(F.sum("n") / F.count("*"), 6).alias("ratio"))


def _scored(spark, sf):
    g = dense(spark, sf)
    return g, layers(g), model()


def logits(spark, sf):
    g, ls, m = _scored(spark, sf)
    return long(T.logits(ls[-1], labels(g), m, 2), ["v"], "z", "c", "z")


def train_val_metrics(spark, sf):
    g, ls, m = _scored(spark, sf)
    z = T.logits(ls[-1], labels(g), m, 2)
    return T.split_metrics(z).select("split", "labelled", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


def grad_aggr(spark, sf):
    g, ls, m = _scored(spark, sf)
    rows = T.head_gradient(T.logits(ls[-1], labels(g), m, 2), m)
    return long(T.aggregate_gradient(rows, m.layers[1][0]), ["v"], "ga", digits=7)


def backward_scatter(spark, sf):
    g, ls, m = _scored(spark, sf)
    rows = T.head_gradient(T.logits(ls[-1], labels(g), m, 2), m)
    return long(T.backward_scatter(g.edges, T.aggregate_gradient(rows, m.layers[1][0]), DIM), ["v"], "gh", digits=7)


def _gradient(at):
    def query(spark, sf):
        g, ls, m = _scored(spark, sf)
        x = T.gradients(g.edges, ls, labels(g), m)[at]
        return matrix(spark, x if x.ndim == 2 else x[:, None], digits=6)

    return query


def sgd_step(spark, sf):
    g, ls, m = _scored(spark, sf)
    return matrix(spark, T.Optimizer("sgd", 0.01).step(m.parameters(), T.gradients(g.edges, ls, labels(g), m))[0], "w", 8)


def legacy_loss(spark, sf):
    g, ls, m = _scored(spark, sf)
    loss, _ = T.legacy_step(ls, m, 0.01)
    return spark.createDataFrame([(loss,)], "loss double").select(F.round("loss", 6).alias("loss"))


def legacy_weight(spark, sf):
    g, ls, m = _scored(spark, sf)
    return matrix(spark, T.legacy_step(ls, m, 0.01)[1].layers[0][0], "w", 6)


def poisoned(state: DataFrame) -> DataFrame:
    """The state with a NaN in every 97th vertex and an infinity in every 89th but one."""
    bad = lambda x, i: F.when((F.col("v") % 97 == 0) & (i == 3), float("nan")).when((F.col("v") % 89 == 1) & (i == 5), float("-inf")).otherwise(x)
    return state.withColumn("h", F.transform("h", bad))


def nan_check(spark, sf):
    return S.state_faults(poisoned(M.initial_state(dense(spark, sf).nodes)))


def buffer_check(spark, sf):
    """Every 61st vertex is missing, and every 53rd has one component less."""
    g = dense(spark, sf)
    short = F.when(F.col("v") % 53 == 0, F.slice("h", 1, DIM - 1)).otherwise(F.col("h"))
    return S.buffer_faults(M.initial_state(g.nodes, DIM).where("v % 61 <> 0").withColumn("h", short), g.n, DIM)


def edge_validity(spark, sf):
    g = dense(spark, sf)
    return S.edge_faults(g.edges, g.n)


def frontier_check(spark, sf):
    """The activity of every 50th vertex but seven is turned over."""
    layer = layers(dag(spark, sf), 1, True)[0]
    return S.frontier_faults(layer.withColumn("active", F.when(F.col("v") % 50 == 7, ~F.col("active")).otherwise(F.col("active"))))


def profile_totals(spark, sf):
    g = dag(spark, sf)
    return M.profile_totals(M.layer_profile(g.edges, layers(g, 3, True), starts(g)), DIM)


def gradient_norms(spark, sf):
    g, ls, m = _scored(spark, sf)
    found = T.norms(T.gradients(g.edges, ls, labels(g), m))
    return spark.createDataFrame(list(enumerate(found)), "pos int, norm double").select("pos", F.round("norm", 6).alias("norm"))


def edge_list_scan(spark, sf):
    """The edges, written as edge-list text and read back."""
    g, path = dense(spark, sf), fresh_folder(spark, "edge-list")
    G.write_edge_list(g.edges, g.n, path)
    edges, n = G.read_edge_list(spark, path)
    return edges.groupBy("s", "t").agg(F.count("*").alias("k")).withColumn("n", F.lit(n).cast("long"))


def _read_back(spark, sf, **limits):
    root = fresh_folder(spark, "dataset")
    G.write_dataset(dense(spark, sf), root)
    return G.read_dataset(spark, root, **limits)


def dataset_nodes(spark, sf):
    """The vertices, written as the gzipped dataset and read back."""
    nodes = _read_back(spark, sf).nodes
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return nodes.select("v", "label", "is_train", "is_val", "is_test", F.size("features").alias("width"), F.round(F.col("features")[3], 6).alias("third"), F.round(total, 4).alias("total"))


def dataset_edges(spark, sf):
    """The edges among the first 150 vertices of that dataset."""
    return _read_back(spark, sf, fraction=0.9, max_nodes=150).edges.groupBy("s", "t").agg(F.count("*").alias("k"))


def checkpoint_scan(spark, sf):
    """The model's parameters, saved and loaded."""
    path = fresh_folder(spark, "model")
    checkpoints.save(spark, model(), path)
    return checkpoints.parameter_rows(spark, checkpoints.load(spark, path, model())).select("pos", "name", "row", "col", F.round("val", 8).alias("val"))


def train_run(spark, sf):
    g = dense(spark, sf)
    return T.train(g.nodes, g.edges, model(), epochs=2, optimizer=T.Optimizer("adam", 0.01))[1]


QUERIES = {f.__name__: f for f in (dataset_summary, first_labels, split_counts, label_histogram, induced_subgraph, node_fraction, out_degree, in_degree, adjacency_csr, reverse_csr, owner_local_id, load_balance, message_volume, memory_estimate, edge_owner_counts, seed_gather, superstep_identity, superstep_linear, ramp_forward, frontier_by_layer, layer_profile, passthrough_vertices, stale_aggregates, contributor_trace, rank_groups, batching_ratio, logits, train_val_metrics, grad_aggr, backward_scatter, sgd_step, legacy_loss, legacy_weight, nan_check, buffer_check, edge_validity, frontier_check, profile_totals, gradient_norms, edge_list_scan, dataset_nodes, dataset_edges, checkpoint_scan, train_run)}
QUERIES |= {f"ranges_{k}": _ranges(k) for k in ("vertex", "edge", "hybrid")}
QUERIES |= {f"partition_stats_{k}": _stats(k) for k in ("vertex", "edge", "hybrid")}
QUERIES |= {f"forward_{k}": _forward(k) for k in (2, 3)}
QUERIES |= {"grad_classifier": _gradient(4), "grad_classifier_bias": _gradient(5), "grad_last_layer": _gradient(2), "grad_last_bias": _gradient(3), "grad_layer0": _gradient(0), "grad_layer0_bias": _gradient(1)}
