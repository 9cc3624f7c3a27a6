"""Motif discovery: the choice of k of the reference, a best k above 6, and its stability."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from ethoflow.operators import motifs


def test_choice_of_k():
    assert motifs.choose_k([2, 3, 4, 5, 6], [0.1, 0.2, 0.3, 0.4, 0.9], [100, 60, 58, 30, 0]) == 4  # the flat step's own k
    assert motifs.choose_k([2, 3, 4, 5, 6], [0.1, 0.9, 0.3, 0.4, 0.2], [100, 60, 58, 30, 0]) == 3  # flat only after the best
    assert motifs.choose_k([2, 3, 4], [0.1, 0.2, 0.9], [100, 50, 49]) == 4  # the last step is no elbow


def windows(spark, points):
    return spark.createDataFrame([("s", i, Vectors.dense([float(x) for x in p])) for i, p in enumerate(points)], ["session_id", "window_start", "features"])


def test_nine_clear_clusters(spark):
    centres = [(x, y) for x in (0, 10, 20) for y in (0, 10, 20)]
    noise = np.random.default_rng(1).normal(0, 0.1, (72, 2))
    labelled, k, sweep = motifs.discover(windows(spark, [np.array(centres[i % 9]) + noise[i] for i in range(72)]))
    assert [s[0] for s in sweep] == list(range(2, 15))  # 72 // 5
    assert k == 9
    got = {}
    for r in labelled.collect():
        got.setdefault(r.window_start % 9, set()).add(r.label)
    assert all(len(v) == 1 for v in got.values()) and len(set.union(*got.values())) == 9
    assert motifs.stability(labelled, k) == pytest.approx(1.0)


def test_sums_of_all_fits_at_once():
    """Each fit's counts, cost and sums are those of a plain assignment, in one batch for all clusters (it was one a fit)."""
    import pyarrow as pa

    draw = np.random.default_rng(2)
    x, bags = draw.normal(size=(motifs.ROWS + 70, 3)), draw.integers(0, 4, motifs.ROWS + 70)
    fits = [(b, draw.normal(size=(k, 3))) for b, k in ((-1, 4), (0, 2), (1, 3), (-1, 5), (0, 3))]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(x[a:b])), pa.array(bags[a:b])], names=["p", "bags"]) for a, b in ((0, 20), (20, len(x)))]
    (got,) = motifs._sums(batches, fits)
    assert got.num_rows == 17
    told = {(r["fit"], r["cluster"]): [r["n"], r["cost"], r["s0"], r["s1"], r["s2"]] for r in got.to_pylist()}
    for i, (bag, centres) in enumerate(fits):
        some = x if bag < 0 else x[(bags >> bag) & 1 == 1]
        d = ((some[:, None] - centres) ** 2).sum(2)
        for c in range(len(centres)):
            mine = d.argmin(1) == c
            assert np.allclose(told[i, c], [mine.sum(), d[mine, c].sum(), *some[mine].sum(0)])
