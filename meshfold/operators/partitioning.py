"""Partition planners, ownership, local ids and adjacency views."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

BLOCK = 65_536


def degrees(edges: DataFrame, n: int, end: str = "s") -> DataFrame:
    """(v, deg) of all vertices 0..n-1, by out-edges ('s') or in-edges ('t')."""
    spark = edges.sparkSession
    seen = edges.groupBy(F.col(end).alias("v")).agg(F.count("*").alias("deg"))
    return spark.range(n).withColumnRenamed("id", "v").join(seen, "v", "left").select("v", F.coalesce("deg", F.lit(0)).alias("deg"))


def running_sum(rows: DataFrame, value: str) -> DataFrame:
    """Add `cum`, the inclusive running sum by v: within blocks of vertices, plus what earlier blocks hold."""
    rows = rows.withColumn("block", F.floor(F.col("v") / BLOCK))
    inside = F.sum(value).over(Window.partitionBy("block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy("block").agg(F.sum(value).alias("own"))
    # one row for each 65,536 vertices
    before = sums.select("block", (F.sum("own").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).alias("before"))
    return rows.withColumn("inside", inside).join(before, "block").select(*[c for c in rows.columns if c != "block"], (F.col("inside") + F.col("before")).alias("cum"))


def vertex_ranges(n: int, ranks: int) -> list[int]:
    return [r * n // ranks for r in range(ranks + 1)]


def cost_ranges(degree: DataFrame, n: int, ranks: int, alpha: float | None = None, beta: float = 1.0) -> list[int]:
    """Greedy boundaries: a rank closes at the first vertex at which its cost reaches the target; overshoot is dropped.

    Without alpha the cost is the degree and the target is rounded up (edge-balanced); with it, alpha + beta * degree.
    """
    if alpha is not None and (alpha < 0 or beta < 0):
        raise ValueError("alpha and beta are not negative")
    if n == 0 or ranks == 1:
        return [0] + [n] * ranks
    cost = F.col("deg") if alpha is None else F.lit(float(alpha)) + F.lit(float(beta)) * F.col("deg")
    table = cut(running_sum(degree.select("v", cost.alias("cost")), "cost"), "running-cost")
    total = table.agg(F.sum("cost")).first()[0]
    if not total or total <= 0:
        return vertex_ranges(n, ranks)
    target = math.ceil(total / ranks) if alpha is None else total / ranks
    starts, base = [0], 0
    while len(starts) < ranks:  # one small aggregate for each rank
        hit = table.where((F.col("cum") >= base + target) & (F.col("v") < n - 1) & (F.col("v") >= starts[-1])).agg(F.min(F.struct("v", "cum")).alias("x")).first()["x"]
        if hit is None:
            break
        starts.append(hit["v"] + 1)
        base = hit["cum"]
    return starts + [n] * (ranks + 1 - len(starts))


def ranges_frame(spark: SparkSession, starts: list[int]) -> DataFrame:
    """(rank, lo, hi); as many rows as ranks."""
    return spark.createDataFrame([(r, a, b) for r, (a, b) in enumerate(zip(starts, starts[1:]))], "rank int, lo long, hi long")


def with_owner(rows: DataFrame, starts: list[int], vertex: str, name: str = "rank") -> DataFrame:
    """Add the owning rank of a vertex; empty ranges own nothing. The few boundaries are part of the expression."""
    owner = F.lit(0)
    for r, lo in enumerate(starts[:-1]):
        if lo < starts[r + 1]:
            owner = F.when(F.col(vertex) >= lo, r).otherwise(owner)
    return rows.withColumn(name, owner)


def local_ids(vertices: DataFrame, starts: list[int]) -> DataFrame:
    """(v, rank, local_id, global_id)."""
    lows = F.array(*map(F.lit, starts))
    return with_owner(vertices, starts, "v").withColumn("local_id", F.col("v") - F.element_at(lows, F.col("rank") + 1)).withColumn("global_id", F.element_at(lows, F.col("rank") + 1) + F.col("local_id"))


def partition_stats(degree: DataFrame, starts: list[int], alpha: float = 10.0, beta: float = 1.0) -> DataFrame:
    """(rank, lo, hi, vertices, edges, cost) of every rank, empty ones included."""
    own = with_owner(degree, starts, "v").groupBy("rank").agg(F.count("*").alias("vertices"), F.sum("deg").alias("edges"), F.sum(alpha + beta * F.col("deg")).alias("cost"))
    return ranges_frame(degree.sparkSession, starts).join(own, "rank", "left").fillna(0, ["vertices", "edges"]).fillna(0.0, ["cost"])


def crossing(edges: DataFrame, starts: list[int]) -> DataFrame:
    """Edges with the ranks of their ends; the rank of s keeps the edge."""
    return with_owner(with_owner(edges, starts, "s", "s_rank"), starts, "t", "t_rank")


def adjacency(edges: DataFrame, n: int) -> DataFrame:
    """Out-adjacency in rows: (v, row_start, neighbours in ascending order)."""
    lists = edges.groupBy(F.col("s").alias("v")).agg(F.sort_array(F.collect_list("t")).alias("neighbours"))
    rows = running_sum(degrees(edges, n), "deg").join(lists, "v", "left")
    return rows.select("v", (F.col("cum") - F.col("deg")).alias("row_start"), F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def reverse_adjacency(edges: DataFrame, n: int, starts: list[int]) -> DataFrame:
    """In-adjacency of edges within a rank."""
    own = crossing(edges, starts).where("s_rank = t_rank").select(F.col("t").alias("s"), F.col("s").alias("t"))
    return adjacency(own, n)


def rank_groups(edges: DataFrame, starts: list[int], senders: DataFrame | None = None) -> DataFrame:
    """Remote contributors grouped for transport: (t, s_rank, sources, n): a gradient goes once to each rank."""
    e = edges if senders is None else edges.join(senders.select(F.col("v").alias("s")), "s", "left_semi")
    return crossing(e, starts).where("s_rank <> t_rank").groupBy("t", "s_rank").agg(F.sort_array(F.collect_list("s")).alias("sources"), F.count("*").alias("n"))
