"""python -m meshfold [GRAPH | --dataset-root DIR] ...: forward run over an edge list, or training on a dataset."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import partitioning as P
from .operators import statistics as S
from .operators import superstep as M
from .operators import training as T
from .operators.timing import Timers
from .sources import checkpoints
from .sources import graphs as G


def starts_for(edges, n: int, ranks: int, mode: str, alpha: float, beta: float) -> list[int]:
    if mode == "vertex":
        return P.vertex_ranges(n, ranks)
    degree = P.degrees(edges, n)
    return P.cost_ranges(degree, n, ranks) if mode == "edge" else P.cost_ranges(degree, n, ranks, alpha, beta)


def main(argv: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(prog="meshfold", allow_abbrev=False)
    ask.add_argument("graph", nargs="?")
    ask.add_argument("--dataset-root", help="the folder of the gzipped dataset")
    ask.add_argument("--dataset", help="print the summary of the dataset of this name and stop; below --dataset-root if that is given, else below data/")
    ask.add_argument("--summary", action="store_true", help="print the summary of --dataset-root and stop")
    ask.add_argument("--max-nodes", type=int, default=0, help="keep so many vertices at most; 0 keeps all")
    ask.add_argument("--fraction", type=float, default=0.0, help="keep this part of the vertices, if between 0 and 1")
    ask.add_argument("--save")
    ask.add_argument("--load")
    ask.add_argument("--dump", help="write the final states of a graph run as text to this folder instead of printing them")
    ask.add_argument("--partition", choices=("vertex", "edge", "hybrid"), default="vertex")
    ask.add_argument("--partition-alpha", type=float, default=10.0)
    ask.add_argument("--partition-beta", type=float, default=1.0)
    ask.add_argument("--ranks", type=int, default=4)
    ask.add_argument("--layers", type=int, default=2)
    ask.add_argument("--hidden", type=int, default=4)
    ask.add_argument("--epochs", type=int, default=2)
    ask.add_argument("--patience", type=int, default=10)
    ask.add_argument("--learning-rate", type=float, default=0.01)
    ask.add_argument("--optimizer", choices=("sgd", "adam"), default="sgd")
    a = ask.parse_args(argv)
    if a.graph and (a.save or a.load):
        ask.error("--save and --load are for datasets; an edge list has no trained parameters")
    spark = SparkSession.builder.appName("meshfold").getOrCreate()
    root = f"{a.dataset_root or 'data'}/{a.dataset}" if a.dataset else a.dataset_root
    if root:
        g = G.read_dataset(spark, root, fraction=a.fraction, max_nodes=a.max_nodes)
        G.summary(g).show()
        g.nodes.select("v", "label").orderBy("v").limit(5).show()
        if a.summary or a.dataset:
            return
        dim = len(g.nodes.select("features").first()["features"])
        report(g.edges, g.n, a, dim)
        model = T.Model.initial(dim, int(g.nodes.selectExpr("max(label) + 1").first()[0]), a.layers)
        if a.load:
            model = checkpoints.load(spark, a.load, model)
        timers = Timers()
        model, history = T.train(g.nodes, g.edges, model, epochs=a.epochs, patience=a.patience, optimizer=T.Optimizer(a.optimizer, a.learning_rate), timers=timers)
        history.show(a.epochs)
        timers.rows(spark).show()
        if a.save:
            checkpoints.save(spark, model, a.save)
    elif a.graph:
        edges, n = G.read_edge_list(spark, a.graph)
        starts = report(edges, n, a, a.hidden)
        state, timers = M.ramp_state(spark.range(n).withColumnRenamed("id", "v"), n, a.hidden), Timers()
        layers = M.forward(edges, state, [(np.eye(a.hidden), np.zeros(a.hidden))] * a.layers, timers)
        if layers:
            profile = M.layer_profile(edges, layers, starts)
            profile.show()
            M.profile_totals(profile, a.hidden).show()
        timers.rows(spark).show()
        lines = final_states(layers[-1] if layers else state)
        if a.dump:
            lines.write.text(a.dump)
        else:
            for r in lines.toLocalIterator():  # every vertex, a partition at a time
                print(r["value"])
    else:
        ask.error("a graph, --dataset or --dataset-root is needed")


def final_states(state: DataFrame) -> DataFrame:
    """(value): a line for each vertex in order, its state with four decimals."""
    shown = F.array_join(F.transform("h", lambda x: F.format_string("%.4f", x)), ", ")
    return state.orderBy("v").select(F.format_string("v%d: [%s]", "v", shown).alias("value"))


def report(edges: DataFrame, n: int, a: argparse.Namespace, dim: int) -> list[int]:
    """Print the partition table, the balance and the messages of one superstep; the ranks' boundaries."""
    starts = starts_for(edges, n, a.ranks, a.partition, a.partition_alpha, a.partition_beta)
    degree = P.degrees(edges, n)
    P.partition_stats(degree, starts, a.partition_alpha, a.partition_beta).orderBy("rank").show(a.ranks)
    S.load_balance(degree, starts).show()
    S.message_volume(edges, starts, dim).show()
    S.memory_estimate(degree, starts, dim).orderBy("rank").show(a.ranks)
    return starts


if __name__ == "__main__":
    main()
