"""The stage's own capacities: all three residuals count, and each piece's bin is the one that a plain search chooses."""

import inspect
import math

import numpy as np
import pytest

from meshfold.llm import packing


def test_all_capacities_are_finite():
    given = {k: v.default for k, v in inspect.signature(packing.pack).parameters.items()}
    assert all(math.isfinite(given[k]) for k in ("capacity", "max_docs", "max_attention"))


def plain_choice(items, caps, weights, rule):
    """Largest first; of all bins that fit, the one with the best score, the oldest of equals."""
    sizes = items / caps
    rooms, out = [], np.empty(len(items), np.int64)
    for i in np.argsort(-(sizes * weights).sum(1), kind="stable"):
        scores = [(float(weights @ ((r - sizes[i]) ** 2)) if rule == "norm" else -float((weights * sizes[i]) @ r), b) for b, r in enumerate(rooms) if (r >= sizes[i] - 1e-12).all()]
        best = min(scores, default=None)
        if best is None:
            rooms.append(1.0 - sizes[i])
            out[i] = len(rooms) - 1
        else:
            low = [b for s, b in scores if s <= best[0] + 1e-12]
            out[i] = low[0]
            rooms[low[0]] = rooms[low[0]] - sizes[i]
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(2048.0, 2048.0, 2048.0**2), (100.0, 4.0, 6000.0), (2048.0, 3.0, math.inf)])
def test_choice_against_plain_search(rule, caps):
    rng = np.random.default_rng(11)
    length = np.exp(rng.uniform(0, math.log(min(caps[0], 70.0 if caps[0] < 2048 else 2048.0)), 300)).astype(int)
    items = np.stack([length, np.ones(300), length**2], axis=1).astype(float)
    caps, weights = np.array(caps), np.array([1.0, 0.7, 0.5])
    live = np.isfinite(caps)
    want = plain_choice(items[:, live], caps[live], weights[live], rule)
    for block in (7, 512):
        got = packing.best_fit(items, caps, weights, rule, block)
        score = [np.bincount(x, items[:, 0]).tolist() for x in (got, want)]
        assert (got == want).mean() > 0.99 and len(score[0]) == len(score[1])  # rounding may part equal scores


def test_every_piece_alone_and_no_piece():
    assert packing.best_fit(np.zeros((0, 3)), np.ones(3), np.ones(3)).tolist() == []
    assert packing.best_fit(np.ones((3, 3)), np.ones(3), np.ones(3)).tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        packing.best_fit(np.full((1, 3), 2.0), np.ones(3), np.ones(3))
