"""Graph sources: tables, edge-list text, and the gzipped dataset layout. Edges are a bag; multi-edges count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The dataset's files below its root; fixed values.
DATASET_FILES = {"features": "raw/node-feat.csv.gz", "labels": "raw/node-label.csv.gz", "edges": "raw/edge.csv.gz", "train": "split/sales_ranking/train.csv.gz", "valid": "split/sales_ranking/valid.csv.gz", "test": "split/sales_ranking/test.csv.gz"}
NUMERIC = r"^[ \t]*[-+0-9]"


@dataclass(frozen=True)
class Graph:
    """nodes (v, features, label, is_train, is_val, is_test), edges (s, t), and the number of vertices."""

    nodes: DataFrame
    edges: DataFrame
    n: int


def node_limit(total: int, fraction: float = 0.0, max_nodes: int = 0) -> int:
    """The prefix of vertices that is kept: a fraction in (0, 1), at least one, then a cap if positive."""
    n = max(1, int(total * fraction)) if 0 < fraction < 1 else total
    return min(n, max_nodes) if max_nodes > 0 else n


def induced(edges: DataFrame, n: int) -> DataFrame:
    """Edges with both ends in 0..n-1."""
    return edges.where((F.col("s") >= 0) & (F.col("t") >= 0) & (F.col("s") < n) & (F.col("t") < n))


def checked(edges: DataFrame, n: int) -> DataFrame:
    bad = edges.where((F.col("s") < 0) | (F.col("t") < 0) | (F.col("s") >= n) | (F.col("t") >= n) | F.col("s").isNull() | F.col("t").isNull()).head(1)
    if bad:
        raise ValueError(f"edge {tuple(bad[0])} is out of range for {n} vertices")
    return edges


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Edge-list text: blank and # lines are skipped, the first data line is `vertices edges`, then `src dst`."""
    pair = r"^\s*(\d+)\s+(\d+)"
    lines = spark.read.text(path)
    with_place = lines.select("value", F.monotonically_increasing_id().alias("at")).where(F.col("value").rlike(pair) & ~F.col("value").rlike(r"^\s*#"))
    head = with_place.orderBy("at").first()
    if head is None:
        raise ValueError(f"{path} has no header line")
    get = lambda k: F.expr(f"try_cast(regexp_extract(value, '{pair.replace(chr(92), chr(92) * 2)}', {k}) AS bigint)")
    n = int(head["value"].split()[0])
    edges = with_place.where(F.col("at") > head["at"]).select(get(1).alias("s"), get(2).alias("t"))
    return checked(edges, n), n


#: A number at the start of a token.
INTEGER, FLOAT = r"[-+]?\d+", r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def numeric_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the lines that begin with a sign or a digit."""
    return spark.read.text(path).where(F.col("value").rlike(NUMERIC))


def numbered(lines: DataFrame) -> DataFrame:
    """Add `at`, the running number of each line: within its partition, after what earlier partitions hold."""
    lines = lines.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33))
    counts = lines.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each partition of the file
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("place"))
    return lines.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("at", (F.col("before") + F.col("inside") - 1).cast("long")).drop("place", "part", "inside", "before")


def integers(value: Column, count: int) -> list[Column]:
    """The first `count` integers of a line, parted by blanks or one comma; null from the first that is none on.

    A token may go on after its number: `12ab` begins with 12, and no further integer follows it.
    """
    more = "".join(rf"(?:[ \t]*,?[ \t]*({INTEGER})" for _ in range(count - 1)) + ")?" * (count - 1)
    row = rf"^[ \t]*({INTEGER})" + more
    return [F.regexp_extract(value, row, i + 1).try_cast("bigint") for i in range(count)]


def floats(value: Column) -> Column:
    """The numbers of a line up to the first token that is none; a comma at the end adds nothing."""
    good = F.regexp_extract(value, rf"^(?:[ \t]*{FLOAT}[ \t]*,?)*", 0)
    return F.transform(F.regexp_extract_all(good, F.lit(f"({FLOAT})"), F.lit(1)), lambda x: x.cast("double"))


def read_dataset(spark: SparkSession, root: str, *, fraction: float = 0.0, max_nodes: int = 0) -> Graph:
    """The gzipped dataset: features and labels by line, edges and splits by id; ragged features fail.

    All vertices are read; `fraction` or a positive `max_nodes` keeps a prefix of them and the edges among these.
    """
    path = {k: f"{root}/{v}" for k, v in DATASET_FILES.items()}
    rows = numbered(numeric_lines(spark, path["features"]))
    total = numeric_lines(spark, path["features"]).count()
    if not total:
        raise ValueError(f"{path['features']} has no feature rows")
    n = node_limit(total, fraction, max_nodes)
    features = rows.where(F.col("at") < n).select(F.col("at").alias("v"), floats(F.col("value")).alias("features"))
    dim = len(features.where("v = 0").first()["features"])
    features = features.withColumn("features", F.when(F.assert_true(F.size("features") == dim, F.lit("feature rows differ in length")).isNull(), F.col("features")))
    # a line without an integer does not count
    label = numeric_lines(spark, path["labels"]).select(integers(F.col("value"), 1)[0].alias("label")).where("label is not null")
    labels = numbered(label).where(F.col("at") < n).select(F.col("at").alias("v"), "label")
    nodes = features.join(labels, "v", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    for name in ("train", "valid", "test"):
        ids = numeric_lines(spark, path[name]).select(integers(F.col("value"), 1)[0].alias("v")).where(f"v >= 0 and v < {n}").distinct()
        flag = {"train": "is_train", "valid": "is_val", "test": "is_test"}[name]
        nodes = nodes.join(ids.withColumn(flag, F.lit(True)), "v", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    s, t = integers(F.col("value"), 2)
    edges = numeric_lines(spark, path["edges"]).select(s.alias("s"), t.alias("t")).where("s is not null and t is not null")
    return Graph(nodes, induced(edges, n), n)


def write_edge_list(edges: DataFrame, n: int, path: str) -> None:
    """Edge-list text, one file, as the format's header is its first line."""
    head = edges.sparkSession.createDataFrame([(f"{n} {edges.count()}",)], "value string")
    head.union(edges.select(F.concat_ws(" ", "s", "t").alias("value"))).coalesce(1).write.text(path)


def write_dataset(g: Graph, root: str) -> None:
    """The dataset layout, gzipped; each file is a folder of one part, as lines of features and labels are numbered."""
    line = lambda df, *c: df.select(F.concat_ws(",", *c).alias("value"))
    by_id = g.nodes.repartition(1).sortWithinPartitions("v")
    parts = {"features": line(by_id, F.transform("features", lambda x: x.cast("string"))), "labels": line(by_id, "label"), "edges": line(g.edges, "s", "t")}
    parts |= {k: line(g.nodes.where(f), "v") for k, f in (("train", "is_train"), ("valid", "is_val"), ("test", "is_test"))}
    for name, df in parts.items():
        df.write.mode("overwrite").option("compression", "gzip").text(f"{root}/{DATASET_FILES[name]}")


def from_tables(spark: SparkSession, sf_dir: str, *, dim: int | None = None, dag: bool = False) -> Graph:
    """The test graph: vertices from `embeddings`, edges from `lineitem`; dag keeps those with s < t, whose frontier shrinks."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = vectors.count()
    x = F.col("embedding").cast("array<double>")
    part = F.col("vec_id") % 10
    nodes = vectors.select(F.col("vec_id").alias("v"), (F.slice(x, 1, dim) if dim else x).alias("features"), F.col("label").cast("long").alias("label"), (part < 6).alias("is_train"), part.isin(6, 7).alias("is_val"), (part > 7).alias("is_test"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = items.select((F.col("l_partkey") % n).alias("s"), (F.col("l_orderkey") % n).alias("t"))
    return Graph(nodes, edges.where("s < t") if dag else edges, n)


def summary(g: Graph) -> DataFrame:
    """One row: nodes, edges, feature_dim, num_classes, train, val, test."""
    count = lambda c: F.count_if(F.col(c)).alias(c[3:])
    nodes = g.nodes.agg(F.count("*").alias("nodes"), F.max(F.size("features")).cast("long").alias("feature_dim"), (F.max("label") + 1).alias("num_classes"), count("is_train"), count("is_val"), count("is_test"))
    return nodes.join(F.broadcast(g.edges.agg(F.count("*").alias("edges"))))  # one row each
