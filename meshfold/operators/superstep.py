"""Message passing: one superstep is a join with the edges, a sum by target, and a row-wise layer.

State rows are (v, h, active). Only active vertices send; a vertex is active after a superstep if it received a
message; inactive ones pass their state through. Sums combine on the map side; the layer adds no shuffle.
"""

from __future__ import annotations

from contextlib import nullcontext

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.vectors import affine, relu, vector_sum


def initial_state(nodes: DataFrame, dim: int | None = None) -> DataFrame:
    """All vertices active, with their features as state; with `dim`, a feature row of another width fails."""
    h = F.col("features")
    if dim is not None:
        h = F.when(F.assert_true(F.size(h) == dim, F.lit(f"feature rows must have the hidden width {dim}")).isNull(), h)
    return nodes.select("v", h.alias("h"), F.lit(True).alias("active"))


def ramp_state(vertices: DataFrame, n: int, dim: int) -> DataFrame:
    """h = (v + 1) / n in every component."""
    return vertices.select("v", F.array_repeat((F.col("v") + 1) / F.lit(float(n)), dim).alias("h"), F.lit(True).alias("active"))


def gather(edges: DataFrame, state: DataFrame, dim: int) -> DataFrame:
    """(v, aggr, received): what each vertex gets from its active in-neighbours."""
    sent = state.where("active").select(F.col("v").alias("s"), "h")
    return edges.join(sent, "s").groupBy(F.col("t").alias("v")).agg(vector_sum("h", dim).alias("aggr"), F.count("*").alias("received"))


def superstep(edges: DataFrame, state: DataFrame, weight, bias) -> DataFrame:
    """(v, before, aggr, received, pre, h, active): aggr is null where nothing was received."""
    dim = len(bias)
    got = gather(edges, state, np.asarray(weight).shape[1])
    rows = state.select("v", F.col("h").alias("before")).join(got, "v", "left")
    rows = rows.withColumn("pre", F.when(F.col("received").isNotNull(), affine(weight, bias, F.col("aggr"))).otherwise(F.col("before")))
    on = F.col("received").isNotNull()
    return rows.select("v", "before", "aggr", F.coalesce("received", F.lit(0)).alias("received"), "pre", F.when(on, relu(F.col("pre"))).otherwise(F.col("before")).alias("h"), on.alias("active"))


def forward(edges: DataFrame, state: DataFrame, layers: list[tuple], timers=None) -> list[DataFrame]:
    """The layers' rows, each written to the shared folder; stops when no vertex is active."""
    done = []
    for k, (weight, bias) in enumerate(layers):
        with timers("superstep", k) if timers else nullcontext():
            layer = cut(superstep(edges, state, weight, bias), "layer")
        if not layer.where("active").head(1):
            break
        done.append(layer)
        state = layer.select("v", "h", "active")
    return done


def stale_aggregates(layers: list[DataFrame], dim: int) -> DataFrame:
    """(v, aggr) after the last layer; a vertex that got nothing keeps its former aggregate, zero at first."""
    now = layers[0].select("v", F.coalesce("aggr", F.array_repeat(F.lit(0.0), dim)).alias("aggr"))
    for layer in layers[1:]:
        now = now.join(layer.select("v", F.col("aggr").alias("new")), "v").select("v", F.coalesce("new", "aggr").alias("aggr"))
    return now


def layer_profile(edges: DataFrame, layers: list[DataFrame], starts: list[int] | None = None) -> DataFrame:
    """A row for each layer: vertices, active, active_fraction, received, remote_received, sent, remote_sent.

    What a layer receives was sent by the one before it (by all vertices, for the first); what it sends goes to the next.
    """
    from .partitioning import crossing

    remote = F.count_if(F.col("s_rank") != F.col("t_rank")) if starts else F.lit(0).cast("long")
    ranked = crossing(edges, starts) if starts else edges
    rows, before = None, ranked.agg(remote.alias("remote_received"))
    for k, layer in enumerate(layers):
        out = ranked.join(layer.where("active").select(F.col("v").alias("s")), "s").agg(F.count("*").alias("sent"), remote.alias("remote_sent"))
        own = layer.agg(F.lit(k).alias("layer"), F.count("*").alias("vertices"), F.count_if("active").alias("active"), F.sum("received").alias("received"))
        row = own.join(F.broadcast(before)).join(F.broadcast(out))  # one row each
        row = row.withColumn("active_fraction", F.when(F.col("vertices") == 0, 0.0).otherwise(F.col("active") / F.col("vertices")))
        rows = row if rows is None else rows.unionByName(row)
        before = out.select(F.col("remote_sent").alias("remote_received"))
    return rows


def profile_totals(profile: DataFrame, dim: int) -> DataFrame:
    """One row over all layers: layers, sent, remote_sent, received, remote_received, bytes sent to other ranks, peak state bytes."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sent", "remote_sent", "received", "remote_received")]
    return profile.agg(F.count("*").alias("layers"), *sums, (F.coalesce(F.sum("remote_sent"), F.lit(0)) * ((2 + dim) * 4)).alias("bytes"), F.coalesce(F.max(F.col("vertices") * (4 * dim * 4)), F.lit(0)).alias("peak_state_bytes"))


def contributor_trace(edges: DataFrame, layer: DataFrame, starts: list[int]) -> DataFrame:
    """(v, sources): remote active in-neighbours of each vertex, for what this layer emits."""
    from .partitioning import crossing

    sent = edges.join(layer.where("active").select(F.col("v").alias("s")), "s")
    return crossing(sent, starts).where("s_rank <> t_rank").groupBy(F.col("t").alias("v")).agg(F.sort_array(F.collect_list("s")).alias("sources"))
