"""permutation_tests makes the 10,000 shuffles of the reference."""

import numpy as np
import pytest

from ethoflow.operators import stats
from ethoflow.plans import adapters, registry


def test_least_p(spark, monkeypatch):
    rows = [(i, "AUTO" if i % 2 else "MACHINERY", float(i % 2 * 1000 + i)) for i in range(1, 61)]
    customers = spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double")
    monkeypatch.setattr(adapters, "table", lambda *_: customers)
    assert [r.p for r in registry.QUERIES["permutation_tests"](spark, "").collect()] == pytest.approx([1 / 10_001])


def test_whole_groups_of_no_difference_have_uniform_p(spark):
    r = np.random.default_rng(1)
    rows = [(f"f{f}", "a" if r.random() < 0.3 else "b", float(1e6 + r.normal()), i) for f in range(120) for i in range(60)]
    df = spark.createDataFrame(rows, "feature string, `group` string, value double, animal long").repartition(6)
    p = sorted(t.p for t in stats.permutation_whole(df, "animal", n=1000).collect())
    gap = max(abs(x - (i + 0.5) / 120) for i, x in enumerate(p))
    assert len(p) == 120 and gap < 1.36 / 120**0.5 + 0.5 / 120  # Kolmogorov-Smirnov at 5 %


def test_whole_groups_agree_with_shuffles(spark):
    r = np.random.default_rng(2)
    rows = [("f", "ab"[i % 2], float(r.normal() + 0.3 * (i % 2)), i) for i in range(120)] + [("g", "ab"[i % 2], float(i % 2 * 50 + r.normal()), i) for i in range(120)] + [("f", "c", None, 900), ("f", None, 1.0, 901)]
    df = spark.createDataFrame(rows, "feature string, `group` string, value double, animal long").repartition(5)
    whole = {t.feature: t.p for t in stats.permutation_whole(df, "animal", n=4000).collect()}
    plain = {t.feature: t.p for t in stats.permutation(df, n=4000).collect()}
    assert whole["f"] == pytest.approx(plain["f"], abs=0.03) and whole["g"] == pytest.approx(1 / 4001)
    assert stats.permutation_whole(df.limit(0), "animal", n=10).collect() == []
