"""Load balance, communication volume, memory estimates and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import finite
from .partitioning import crossing, partition_stats

FLOAT_BYTES = 4


def load_balance(degree: DataFrame, starts: list[int]) -> DataFrame:
    """One row of least, most, mean and most/mean of vertices and edges by rank; empty ranks count."""
    stats = partition_stats(degree, starts)
    out = []
    for c in ("vertices", "edges"):
        out += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"avg_{c}"), F.when(F.avg(c) == 0, 1.0).otherwise(F.max(c) / F.avg(c)).alias(f"{c}_imbalance")]
    return stats.agg(F.sum("vertices").alias("total_vertices"), F.sum("edges").alias("total_edges"), *out)


def message_volume(edges: DataFrame, starts: list[int], dim: int) -> DataFrame:
    """(messages, local_messages, remote_messages, remote_fraction, bytes) if every vertex sends once."""
    remote = F.count_if(F.col("s_rank") != F.col("t_rank"))
    m = crossing(edges, starts).agg(F.count("*").alias("messages"), remote.alias("remote_messages"))
    return m.select("messages", (F.col("messages") - F.col("remote_messages")).alias("local_messages"), "remote_messages", F.when(F.col("messages") == 0, 0.0).otherwise(F.col("remote_messages") / F.col("messages")).alias("remote_fraction"), (F.col("remote_messages") * ((2 + dim) * FLOAT_BYTES)).alias("bytes"))


def memory_estimate(degree: DataFrame, starts: list[int], dim: int) -> DataFrame:
    """(rank, bytes) of four state buffers."""
    return partition_stats(degree, starts).select("rank", (F.col("vertices") * (4 * dim * FLOAT_BYTES)).alias("bytes"))


def state_faults(state: DataFrame) -> DataFrame:
    """One row: vertices, and those whose state is not finite."""
    return state.agg(F.count("*").alias("vertices"), F.count_if(~finite(F.col("h"))).alias("not_finite"))


def buffer_faults(state: DataFrame, n: int, dim: int) -> DataFrame:
    """One row: vertices that are missing or repeated among 0..n-1, and those whose vector has another width or holds a null."""
    own = F.col("h").isNull() | (F.size("h") != dim) | F.exists("h", lambda x: x.isNull())
    wrong = state.agg(F.count_if(own).alias("wrong_width"), (F.count("*") - F.count_distinct("v")).alias("repeated"), F.count_distinct(F.when((F.col("v") >= 0) & (F.col("v") < n), F.col("v"))).alias("there"))
    return wrong.select((n - F.col("there")).alias("missing"), "repeated", "wrong_width")


def edge_faults(edges: DataFrame, n: int) -> DataFrame:
    """One row: edges, those out of range, self-loops, and repeats of an edge."""
    e = edges.groupBy("s", "t").agg(F.count("*").alias("k"))
    out = (F.col("s") < 0) | (F.col("t") < 0) | (F.col("s") >= n) | (F.col("t") >= n)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("k")).otherwise(0)), F.lit(0))
    return e.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("edges"), total(out).alias("out_of_range"), total(F.col("s") == F.col("t")).alias("self_loops"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeats"))


def frontier_faults(layer: DataFrame) -> DataFrame:
    """One row: vertices whose activity and number of received messages disagree."""
    return layer.agg(F.count("*").alias("vertices"), F.count_if(F.col("active") != (F.col("received") > 0)).alias("faults"))
