"""Loss, exact gradients, optimizers and the full-batch training loop.

Parameters are a few small matrices and stay on the driver; all work per vertex or edge is in DataFrames. A
gradient is the exact one of the mean loss over all selected vertices, whatever the partitioning: sources of a
layer's messages are the vertices active before it, and the mean is global.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, discard
from ..functions.vectors import affine, argmax, gate, log_sum_exp, outer_sums, relu, vector_sum
from .superstep import forward, initial_state
from .timing import Timers


@dataclass
class Model:
    """Layers (weight, bias) from the first on, and the classifier head."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    head: tuple[np.ndarray, np.ndarray]

    @classmethod
    def initial(cls, dim: int, classes: int, depth: int = 2, seed: int = 0) -> Model:
        """Identity layers; a seeded small normal head."""
        rng = np.random.default_rng(seed)
        return cls([(np.eye(dim), np.zeros(dim)) for _ in range(depth)], (rng.normal(size=(classes, dim)) * 0.01, np.zeros(classes)))

    def parameters(self) -> list[np.ndarray]:
        """W0, b0, ..., head weight, head bias."""
        return [p for pair in (*self.layers, self.head) for p in pair]

    def with_parameters(self, p: list[np.ndarray]) -> Model:
        pairs = list(zip(p[::2], p[1::2]))
        return Model(pairs[:-1], pairs[-1])


def logits(layer: DataFrame, labels: DataFrame, model: Model, depth: int) -> DataFrame:
    """(v, label, splits, aggr, pre, z, active) of the last executed layer, with the current parameters."""
    weight, bias = model.layers[depth - 1]
    rows = layer.select("v", "aggr", "active").where("active").withColumn("pre", affine(weight, bias, F.col("aggr")))
    rows = rows.withColumn("hidden", relu(F.col("pre")))
    return rows.withColumn("z", affine(*model.head, F.col("hidden"))).join(labels, "v")


def split_metrics(scored: DataFrame, splits: tuple[str, ...] = ("is_train", "is_val", "is_test")) -> DataFrame:
    """A row for each split (split, labelled, loss, accuracy) over its active vertices, in one pass; zeros if there are none."""
    lse = log_sum_exp(F.col("z"))
    rows = scored.select(*splits, (lse - F.element_at("z", (F.col("label") + 1).cast("int"))).alias("loss"), (argmax(F.col("z")) == F.col("label")).cast("double").alias("hit"))
    mean = lambda x, s: F.coalesce(F.avg(F.when(F.col(s), F.col(x))), F.lit(0.0)).alias({"loss": "loss", "hit": "accuracy"}[x])
    return rows.agg(F.array(*(F.struct(F.lit(s.removeprefix("is_")).alias("split"), F.count_if(F.col(s)).alias("labelled"), mean("loss", s), mean("hit", s)) for s in splits)).alias("x")).select(F.inline("x"))


def metrics(scored: DataFrame, split: str) -> DataFrame:
    """One row: labelled, loss, accuracy over active vertices of a split; zeros if there are none."""
    return split_metrics(scored, (split,)).drop("split")


def head_gradient(scored: DataFrame, model: Model, split: str = "is_train") -> DataFrame:
    """(v, dz, g_pre, aggr, hidden) of the split's rows: the loss's gradients at the logits and the last layer."""
    own = scored.where(split)
    n = max(1, own.count())
    dz = F.transform(F.col("z"), lambda x, i: (F.exp(x - F.col("lse")) - (i == F.col("label")).cast("double")) / n)
    rows = own.withColumn("lse", log_sum_exp(F.col("z"))).withColumn("dz", dz)
    back = affine(model.head[0].T, np.zeros(model.head[0].shape[1]), F.col("dz"))
    return rows.select("v", "dz", gate(back, F.col("pre")).alias("g_pre"), "aggr", "hidden")


def aggregate_gradient(rows: DataFrame, weight: np.ndarray) -> DataFrame:
    """(v, ga): the gradient at the layer's aggregate."""
    return rows.select("v", affine(weight.T, np.zeros(weight.shape[1]), F.col("g_pre")).alias("ga"))


def backward_scatter(edges: DataFrame, grads: DataFrame, dim: int) -> DataFrame:
    """(v, gh): the transpose of the gather, every edge's source gets its target's gradient."""
    return edges.join(grads.withColumnRenamed("v", "t"), "t").groupBy(F.col("s").alias("v")).agg(vector_sum("ga", dim).alias("gh"))


def layer_gradient(layer: DataFrame, gh: DataFrame) -> DataFrame:
    """(v, g_pre, aggr) of a layer's active vertices."""
    return layer.where("active").select("v", "pre", "aggr").join(gh, "v").select("v", gate(F.col("gh"), F.col("pre")).alias("g_pre"), "aggr")


def norms(parameters: list[np.ndarray]) -> list[float]:
    """The Euclidean norm of each parameter or gradient."""
    return [float(np.sqrt((p * p).sum())) for p in parameters]


def gradients(edges: DataFrame, layers: list[DataFrame], labels: DataFrame, model: Model) -> list[np.ndarray]:
    """Gradients of all parameters in order; layers that were not executed have none."""
    depth = len(layers)
    out: list = [np.zeros_like(p) for p in model.parameters()]
    if not depth:
        return out
    rows = cut(head_gradient(logits(layers[-1], labels, model, depth), model), "head-gradient")
    out[-2:] = outer_sums(rows, "dz", "hidden", model.head[0].shape)
    for k in range(depth - 1, -1, -1):
        weight = model.layers[k][0]
        out[2 * k : 2 * k + 2] = outer_sums(rows, "g_pre", "aggr", weight.shape)
        if k:
            gh = backward_scatter(edges, aggregate_gradient(rows, weight), weight.shape[1])
            used, rows = rows, cut(layer_gradient(layers[k - 1], gh), "layer-gradient")
            discard(used)
    discard(rows)
    return out


@dataclass
class Optimizer:
    """sgd, or adam with the usual decay rates."""

    kind: str = "sgd"
    rate: float = 0.01
    steps: int = 0
    first: list = field(default_factory=list)
    second: list = field(default_factory=list)

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        if self.kind == "sgd":
            return [p - self.rate * g for p, g in zip(params, grads)]
        if self.kind != "adam":
            raise ValueError(f"unknown optimizer {self.kind}")
        self.steps += 1
        self.first = [0.9 * m + 0.1 * g for m, g in zip(self.first or [0.0] * len(grads), grads)]
        self.second = [0.999 * v + 0.001 * g * g for v, g in zip(self.second or [0.0] * len(grads), grads)]
        a, b = 1 - 0.9**self.steps, 1 - 0.999**self.steps
        return [p - self.rate * (m / a) / (np.sqrt(v / b) + 1e-8) for p, m, v in zip(params, self.first, self.second)]


def train(nodes: DataFrame, edges: DataFrame, model: Model, *, epochs: int = 2, patience: int = 10, optimizer: Optimizer | None = None, refresh_forward: bool = True, timers: Timers | None = None) -> tuple[Model, DataFrame]:
    """The trained model and a row for each epoch, the last with the test accuracy of the final parameters.

    Training stops early when the validation accuracy has not risen for `patience` epochs. Without
    refresh_forward the layers of the first epoch are used throughout. The edges are dealt out by source once, so that
    supersteps do not move them; tables of layers are deleted when the next epoch's are there.
    """
    optimizer, timers = optimizer or Optimizer(), timers or Timers()
    spark = nodes.sparkSession
    labels = nodes.select("v", "label", "is_train", "is_val", "is_test")
    edges = edges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s").persist(StorageLevel.MEMORY_AND_DISK)
    layers, history, best, stale = [], [], -1.0, 0
    for epoch in range(1, epochs + 1):
        if refresh_forward or not layers:
            for used in layers:
                discard(used)
            with timers("forward"):
                layers = forward(edges, initial_state(nodes), model.layers, timers)
        with timers("backward"):
            grads = gradients(edges, layers, labels, model)
        with timers("step"):
            model = model.with_parameters(optimizer.step(model.parameters(), grads))
        row = [0.0] * 4
        if layers:
            with timers("metrics"):
                found = {r["split"]: r for r in split_metrics(logits(layers[-1], labels, model, len(layers)), ("is_train", "is_val")).collect()}
            row = [found[s][x] for s in ("train", "val") for x in ("loss", "accuracy")]
        history.append((epoch, *row, float(norms(grads)[0]), None))
        stale = 0 if history[-1][4] > best else stale + 1
        best = max(best, history[-1][4])
        if stale >= patience:
            break
    if layers:
        test = metrics(logits(layers[-1], labels, model, len(layers)), "is_test").first()["accuracy"]
        history[-1] = (*history[-1][:-1], test)
    for used in layers:
        discard(used)
    edges.unpersist()
    schema = "epoch int, train_loss double, train_accuracy double, val_loss double, val_accuracy double, first_gradient_norm double, test_accuracy double"
    return model, spark.createDataFrame(history, schema)


def legacy_step(layers: list[DataFrame], model: Model, rate: float) -> tuple[float, Model]:
    """The self-supervised step: the sum over layers of the mean square of its active outputs."""
    loss, params = 0.0, model.parameters()
    for k, layer in enumerate(layers):
        weight, bias = model.layers[k]
        rows = layer.where("active").select("aggr", affine(weight, bias, F.col("aggr")).alias("pre"))
        n = rows.count() * len(bias)
        if not n:
            continue
        rows = rows.select("aggr", F.transform(relu(F.col("pre")), lambda x: x * (2.0 / n)).alias("d"))
        loss += rows.agg(F.sum(F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x))).first()[0] * n / 4
        gw, gb = outer_sums(rows, "d", "aggr", weight.shape)
        params[2 * k], params[2 * k + 1] = params[2 * k] - rate * gw, params[2 * k + 1] - rate * gb
    return loss, model.with_parameters(params)
