"""Vectors as array<double> columns: sums, matrix products, activations.

Sums, gates and small matrices stay in the JVM; products with larger matrices, and sums of outer products, go through
Arrow batches to NumPy, one matrix product a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many products a matrix is written out as one generated expression.
INLINE = 256


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an array column without nulls, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def lists_of(rows: np.ndarray, there: np.ndarray | None = None) -> pa.ListArray:
    """An array column of the rows; null where `there` is false."""
    there = np.ones(len(rows), bool) if there is None else there
    offsets = np.concatenate([[0], np.cumsum(np.where(there, rows.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[there].ravel()), mask=pa.array(~there))


def vector_sum(vec: str | Column, dim: int) -> Column:
    """Sum of a group's vectors, component by component; combines on the map side."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.array(*(F.sum(v[i]) for i in range(dim)))


def literal(values) -> Column:
    return F.array(*(F.lit(float(x)) if np.isscalar(x) else literal(x) for x in values))


def affine(matrix, bias, vec: Column) -> Column:
    """matrix @ vec + bias; null for a null vector."""
    m, b = np.asarray(matrix, float), np.asarray(bias, float)
    if m.size <= INLINE:
        rows = []
        for w, c in zip(m, b):
            terms = [F.lit(float(x)) * vec[j] for j, x in enumerate(w) if x]
            total = F.lit(float(c))
            for t in terms:
                total = total + t
            rows.append(total)
        return F.when(vec.isNotNull(), F.array(*rows))

    @F.arrow_udf("array<double>")
    def product(v: pa.Array) -> pa.Array:
        there = np.array(v.is_valid())
        out = np.zeros((len(v), len(b)))
        out[there] = rows_of(v.filter(v.is_valid()), m.shape[1]) @ m.T + b
        return lists_of(out, there)

    return product(vec)


def relu(vec: Column) -> Column:
    """x where x > 0, else 0; a NaN gives 0."""
    return F.transform(vec, lambda x: F.when((x > 0) & ~F.isnan(x), x).otherwise(F.lit(0.0)))


def gate(grad: Column, pre: Column) -> Column:
    """The gradient where the activation was open."""
    return F.zip_with(grad, pre, lambda g, p: F.when((p > 0) & ~F.isnan(p), g).otherwise(F.lit(0.0)))


def log_sum_exp(vec: Column) -> Column:
    top = F.array_max(vec)
    return top + F.log(F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def argmax(vec: Column) -> Column:
    """The first place of the largest component."""
    return F.array_position(vec, F.array_max(vec)) - 1


def outer_sums(rows: DataFrame, grad: str, value: str, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of grad (x) value over all rows, and that of grad.

    A task gives its part as `shape[0]` rows; these are added up by row number, so the driver gets one matrix.
    """

    def part(batches):
        total = np.zeros((shape[0], shape[1] + 1))
        for batch in batches:
            g, x = (rows_of(batch.column(i), d) for i, d in enumerate(shape))
            total[:, :-1] += g.T @ x
            total[:, -1] += g.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(shape[0], dtype=np.int32)), "w": lists_of(total)})

    parts = rows.select(grad, value).mapInArrow(part, "i int, w array<double>")
    out = np.zeros((shape[0], shape[1] + 1))
    for r in parts.groupBy("i").agg(vector_sum("w", shape[1] + 1).alias("w")).collect():  # as many rows as the parameter
        out[r["i"]] = r["w"]
    return out[:, :-1], out[:, -1]


def finite(vec: Column) -> Column:
    return F.forall(vec, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
