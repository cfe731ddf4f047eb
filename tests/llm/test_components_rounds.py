"""Components of graphs that one task does not hold, against union-find."""

import numpy as np
import pytest

from meshfold.llm import components


def least_of(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("task_edges", [20, 1 << 18])
def test_random_graph_with_a_hub_and_a_chain(spark, task_edges):
    rng = np.random.default_rng(3)
    pairs = rng.integers(-(1 << 60), 1 << 60, 260)[rng.integers(0, 260, (150, 2))].tolist()
    pairs += [(500, 1000 + k) for k in range(60)] + [(2000 + k, 2001 + k) for k in range(40)] + [(7, 7), (500, 1000)]
    want = least_of([(a, b) for a, b in pairs if a != b])
    edges = spark.createDataFrame([(a, b) for a, b in pairs] + [(None, 1), (2, None)], "a long, b long").repartition(5)
    found = {r.node: r.root for r in components.stars(edges, task_edges=task_edges).collect()}
    assert found == {x: y for x, y in want.items() if x != y}


def test_both_forms_on_no_edges(spark):
    edges = spark.createDataFrame([], "a long, b long")
    assert components.stars(edges).collect() == [] and components.components(edges).collect() == []
