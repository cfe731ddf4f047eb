"""Copies that differ by an appended or cut block, which move more bits of a word fingerprint than the ring allows."""

import numpy as np

from meshfold.llm import text_dedup


def test_block_copies_are_dropped(spark):
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    rows = []
    for k in range(40):
        base = word(int(rng.integers(60, 300)))
        grown, cut = base + word(len(base) * 18 // 100), base[: len(base) * 85 // 100]
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(grown)), (3 * k + 2, " ".join(cut))]
    by_id = dict(rows)
    alike = [(i, j) for i, j in ((3 * k, 3 * k + d) for k in range(40) for d in (1, 2)) if text_dedup.similar(by_id[i], by_id[j]) >= 0.8]
    assert len(alike) == 80


    kept = text_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [3 * k for k in range(40)]
