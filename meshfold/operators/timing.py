"""Wall-clock times by phase and layer, on the driver: Spark runs a step when its result is asked for."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Timers:
    """with timers("forward", 0): ... adds to that phase and layer."""

    def __init__(self):
        self.spent: dict[tuple[str, int | None], list] = {}

    @contextmanager
    def __call__(self, phase: str, layer: int | None = None):
        start = time.perf_counter()
        try:
            yield
        finally:
            one = self.spent.setdefault((phase, layer), [0, 0.0])
            one[0] += 1
            one[1] += time.perf_counter() - start

    def total(self, phase: str) -> float:
        """Seconds of a phase over all layers."""
        return sum(s for (p, _), (_, s) in self.spent.items() if p == phase)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(phase, layer, calls, seconds); a row of a null layer for what is not timed by layer."""
        return spark.createDataFrame([(p, k, n, s) for (p, k), (n, s) in self.spent.items()], "phase string, layer int, calls int, seconds double")
