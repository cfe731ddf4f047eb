"""Model parameters as a Parquet table (pos, name, row, col, val): written once, read with shape checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.training import Model


def parameter_rows(spark: SparkSession, model: Model) -> DataFrame:
    names = [f"{x}{k}" for k in range(len(model.layers)) for x in "Wb"] + ["Wc", "bc"]
    rows = [(pos, name, i, j, float(x)) for pos, (name, p) in enumerate(zip(names, model.parameters())) for i, r in enumerate(np.atleast_2d(p.T).T) for j, x in enumerate(np.atleast_1d(r))]
    return spark.createDataFrame(rows, "pos int, name string, row int, col int, val double")


def save(spark: SparkSession, model: Model, path: str) -> None:
    parameter_rows(spark, model).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, like: Model) -> Model:
    """Raises if the number of parameters or a shape differs from `like`."""
    want = like.parameters()
    got: dict[int, dict] = {}
    for r in spark.read.parquet(path).collect():  # as many rows as parameters
        got.setdefault(r["pos"], {})[r["row"], r["col"]] = r["val"]
    if len(got) != len(want):
        raise ValueError(f"{len(got)} parameters, {len(want)} expected")
    out = []
    for pos, p in enumerate(want):
        a = np.full(np.atleast_2d(p.T).T.shape, np.nan)
        if len(got[pos]) != a.size or any(i >= a.shape[0] or j >= a.shape[1] for i, j in got[pos]):
            raise ValueError(f"parameter {pos} has another shape")
        for at, x in got[pos].items():
            a[at] = x
        out.append(a.reshape(p.shape))
    return like.with_parameters(out)
