"""Hand-derived values of FIXTURES.md: T3 (groups) and T4 (false discovery rate), and the metric block with ties."""

import pytest

from ethoflow.operators import motifs, stats


def groups(spark, values):
    return spark.createDataFrame([("f", g, float(v)) for g, vs in values.items() for v in vs], "feature string, `group` string, value double")


def test_two_groups(spark):
    rows = groups(spark, {"A": [1, 2, 3, 4], "B": [3, 5, 7, 9]})
    w = stats.welch(rows).first()
    assert (w.t, w.df, w.cohen_d) == pytest.approx((-2.424871, 4.411765, -1.714643), abs=1e-6)
    assert stats.mann_whitney(rows).first().u == 1.5


def test_three_groups(spark):
    assert stats.anova(groups(spark, {"a": [1, 2, 3], "b": [2, 3, 4], "c": [5, 6, 7]})).first().f == pytest.approx(13.0)


def test_fdr(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "test int, p double")
    assert [r.q for r in stats.fdr(rows).orderBy("test").collect()] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_metric_block_with_ties(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.5), (0, 0, 0.5), (0, 1, 0.7), (0, 0, 0.1), (None, 1, 0.3)], "y int, pred int, score double")
    m = motifs.classification_metrics(rows, buckets=4).first()
    assert (m.tp, m.tn, m.pos, m.neg) == (1, 2, 2, 3)
    assert m.auc == pytest.approx((3 + 1.5) / 6)
