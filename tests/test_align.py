import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossade.operators import align
from glossade.plans import shift

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_unrestricted_searches_the_whole_vocabulary(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    unit = {r.vec_id: np.array(r.embedding, dtype=float) / np.linalg.norm(np.array(r.embedding, dtype=float)) for r in rows}
    seeds = [r.vec_id for r in rows if r.label == 0][:20]
    got = {(r.seed, r.lang): r for r in shift.align_unrestricted(spark, SF).collect()}
    beyond = 0
    for lang in {r.label for r in rows if r.label > 0}:
        targets = [r.vec_id for r in rows if r.label == lang]
        for s in seeds:
            cos = [float(unit[s] @ unit[t]) for t in targets]
            at = int(np.argmax(cos))
            r = got[s, lang]
            assert r.cosine == pytest.approx(cos[at], abs=2e-6)
            hit = cos[at] >= 0.3
            assert (r.matched, r.lpr_rank) == ((targets[at], at + 1) if hit else (None, None))
            assert (r.hit_at_10, r.hit_at_50) == (int(hit and at < 10), int(hit and at < 50))
            beyond += at >= 50
    assert beyond > 0


def test_searched_is_the_best_of_all_pairs(spark, monkeypatch):
    """Blocks, copies (the best rank stands for them), vectors of length 0 on either side; a row a seed, language and block goes on, not one a pair."""
    rng = np.random.default_rng(7)
    some = rng.normal(size=(40, 8)).round(1).tolist()
    seeds = spark.createDataFrame([(i, v) for i, v in enumerate([*some[:12], [0.0] * 8])], "seed long, vec array<float>")
    rows = [(i % 3, i, some[i % 40]) for i in range(120)] + [(0, 200, [0.0] * 8), (7, 201, [0.0] * 8), (7, 202, [0.0] * 8)]
    targets = align.ranked_targets(spark.createDataFrame(rows, "lang int, target long, vec array<float>"), [F.col("target")])
    want = align.unrestricted(align.similarities(seeds, targets, None), [10, 50], 0.3)
    monkeypatch.setattr(align, "BLOCK", 6)
    found = align.searched(seeds, targets)
    got = align.unrestricted(found, [10, 50], 0.3)
    assert got.schema == want.schema and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert found.count() < 13 * 123 / 2
