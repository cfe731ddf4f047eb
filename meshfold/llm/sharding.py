"""K-d tree partitioning into shards of near equal bytes.

Rows with equal texts form a group that stays together; a null text counts as an empty one. A group is a point
in the metadata space (its least position, its length, hashes of its least source and language) with its bytes
as weight. The tree is split level by level, all its nodes at once: along the node's widest dimension, at the
weighted quantile that gives each side the bytes of its leaves (the median where both have as many). The
quantile is found by distributed histograms: over the dimension, then, among the groups of the crossing cell,
over a hash, so ties are cut too. Groups heavier than 1/200 of a shard go to shards first, largest to
the emptiest (at most 200 times the number of shards); leaves get what their shards have left.

Only histograms, ranges and those heavy groups, all bounded by the number of shards, come to the driver.

Slots: rows are numbered within (shard, bucket) and buckets follow each other, so no task sorts a whole shard.

Cases: a null id, source or language is a value of its own; repeated rows stay in one shard and have slots of
their own; with fewer groups than shards some shards are empty; an empty table gives no rows; columns other
than the named ones are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

CELLS = 4096


def _quantile(cells: dict[int, int], goal: float) -> tuple[int, float]:
    """The cell in which the running weight reaches the goal, and what of the goal falls into it."""
    for c in sorted(cells):
        if cells[c] > goal:
            return c, goal
        goal -= cells[c]
    return max(cells) + 1, 0.0


def bin_of(x: Column, low: float, width: float) -> Column:
    return F.least(F.floor((x - low) / width).cast("int"), F.lit(CELLS - 1)) if width else F.lit(0)


def kd_shards(groups: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """(g, shard) of groups (g, w, the dims as doubles)."""
    groups = groups.withColumn("h", F.xxhash64("g")).withColumns({"h1": F.shiftrightunsigned("h", 52).cast("int"), "h2": F.shiftrightunsigned("h", 40).bitwiseAND(CELLS - 1).cast("int")}).drop("h")
    total = groups.agg(F.sum("w")).first()[0] or 0
    most = total / shards / 200
    heavy = groups.where(F.col("w") > most).select("g", "w").orderBy(F.desc("w"), "g").collect()
    load, place = np.zeros(shards), []
    for r in heavy:
        s = int(load.argmin())
        load[s] += r["w"]
        place.append((r["g"], s))
    rest, level = total - load.sum(), np.sort(load)
    fill = next((x for k in range(shards, 0, -1) if (x := (rest + level[:k].sum()) / k) >= level[k - 1]), 0.0)
    room = np.maximum(fill - load, 0.0)
    # a node is a run of leaves; the column holds its first
    light = materialize(groups.where(F.col("w") <= most).withColumn("node", F.lit(0)), "kd-level")
    ends = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    whole = light.agg(*ends).first()
    open_ = [(0, shards)]
    while open_ := [n for n in open_ if n[1] - n[0] > 1]:
        ranges = {r["node"]: r for r in light.groupBy("node").agg(F.sum("w").alias("w"), *ends).collect()}
        plan: dict[int, tuple] = {}
        goal: dict[int, float] = {}
        for lo, hi in open_:
            if r := ranges.get(lo):
                dim = max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / max(whole[f"hi_{d}"] - whole[f"lo_{d}"], 1e-300))
                plan[lo] = ((lo + hi) // 2, dim, r[f"lo_{dim}"], (r[f"hi_{dim}"] - r[f"lo_{dim}"]) / CELLS)
                goal[lo] = r["w"] * room[lo : plan[lo][0]].sum() / max(room[lo:hi].sum(), 1e-300)
        if not plan:
            break
        cell = F.coalesce(*(F.when(F.col("node") == lo, bin_of(F.col(dim), low, width)) for lo, (_, dim, low, width) in plan.items()))
        light = light.where(F.col("node").isNotNull()).withColumn("cell", cell)
        now, cut = light, {lo: [] for lo in plan}
        for column in ("cell", "h1", "h2"):
            cells: dict[int, dict[int, int]] = {}
            for r in now.where(F.col("node").isin(*plan)).groupBy("node", column).agg(F.sum("w").alias("w")).collect():
                cells.setdefault(r["node"], {})[r[column]] = r["w"]
            for lo in plan:
                c, goal[lo] = _quantile(cells[lo], goal[lo]) if lo in cells else (0, 0.0)
                cut[lo].append(c)
            at = F.coalesce(*(F.when(F.col("node") == lo, c[-1]) for lo, c in cut.items()))
            now = now.where(F.col(column) == at)
        key = F.struct("cell", "h1", "h2")
        moved = [F.when(F.col("node") == lo, F.when(key < F.struct(*map(F.lit, cut[lo])), lo).otherwise(mid)) for lo, (mid, *_) in plan.items()]
        light = materialize(light.withColumn("node", F.coalesce(*moved, "node")).drop("cell"), "kd-level")
        open_ = [x for lo, hi in open_ for x in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
    fixed = groups.sparkSession.createDataFrame(place, "g long, shard int")
    return light.select("g", F.col("node").alias("shard")).union(fixed)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", *, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, by the law `bytes`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")), F.lit(-1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g"), code(source_col).alias("source"), code(lang_col).alias("lang"))
    rows = materialize(rows, "shard-rows")
    dims = {"place": F.min("doc_id"), "length": F.max("size"), "source": F.min("source"), "lang": F.min("lang")}
    groups = rows.groupBy("g").agg(F.sum("size").alias("w"), *(F.coalesce(x.cast("double"), F.lit(-1.0)).alias(k) for k, x in dims.items()))
    named = kd_shards(materialize(groups, "shard-groups"), list(dims), shards)
    rows = rows.join(named, "g").select("doc_id", "size", "text_crc32", "shard", "g")
    n = shuffle_partitions(docs.sparkSession)
    rows = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "g"), F.lit(n)).cast("int")).drop("g"), "sharded")
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # one row for each shard and bucket: bounded by shards * shuffle partitions
    before = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.withColumn("rn", F.row_number().over(within)).join(before, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rn") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
