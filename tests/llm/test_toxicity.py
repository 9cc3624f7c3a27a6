import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoflow.llm.hashing import coefficients, mix
from ethoflow.llm.toxicity import BEGINNINGS, BITS, SENTENCE, fit, toxicity, train


def corpus(n=600, seed=5):
    r = random.Random(seed)
    clean = [f"wort{i}" for i in range(200)]
    bad = [f"zapf{x}" for x in ("a", "ber", "lich", "ig", "ung", "en")] + ["grumble"]
    rows, labels = [], []
    for i in range(n):
        sentences = [r.choices(clean, k=r.randrange(4, 15)) for _ in range(r.randrange(1, 12))]
        toxic = r.random() < 0.2
        if toxic:
            r.choice(sentences).extend(r.choices(bad, k=2))
        rows.append((i, " ".join(" ".join(s).capitalize() + "." for s in sentences)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_place(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    seen = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, seen).collect()}
    assert len(got) == len(rows)
    right = sum(got[i].predicted == t for i, t in labels if i >= 400)
    assert right >= 0.97 * 200
    texts, at = dict(rows), 0
    for i, t in labels:
        if t and got[i].predicted:
            cut = " ".join(texts[i][s.start : s.stop] for s in got[i].sentences).lower()
            at += "zapf" in cut or "grumble" in cut
    assert at >= 100 * 0.9


def test_nulls_and_empty(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "bad"), (2, "good"), (3, None), (None, ""), (2, "good")], "doc_id long, text string")
    got = toxicity(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity(docs.limit(0), labels).collect() == []
    assert {r.predicted for r in toxicity(docs, labels.limit(0)).collect()} == {0}


def plain_score(text, weights, bias):
    """Noisy-or of sentence scores, word by word."""
    c = [int(x) for x in coefficients(64)]
    mixed = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0])
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    sentences, last, size = [], 0, 0
    for m in re.finditer(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", data):
        if not sentences or size == SENTENCE or re.search(rb"[.!?\n]", data[last : m.start()]):
            sentences.append(bias)
            size = 0
        word = m[0]
        whole = mixed(sum((b + 1) * c[j] for j, b in enumerate(word)) + len(word))
        keys = [whole] + [mixed(sum((b + 1) * c[j] for j, b in enumerate(word[:n])) + n - 1) if len(word) > n else whole for n in BEGINNINGS]
        sentences[-1] += sum(weights.get(k >> (64 - BITS), 0.0) for k in keys)
        last, size = m.end(), size + 1
    left = 1.0
    for s in sentences:
        left *= 1 - 1 / (1 + math.exp(-s))
    return 1 - left


def test_scores_against_brute_force(spark):
    rows, labels = corpus(200)
    rows += [(900, None), (901, ""), (902, "... \n"), (903, "wort1 " * 20_000), (904, "Zapfig! " * 300 + "É日本 zapfung"), (905, "x" * 100_000)]
    model = fit([t for _, t in rows[:200]], [y for _, y in labels])
    weights = dict(zip(model[0].tolist(), model[1].astype(np.float32).tolist()))
    got = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), None, model=model).collect()
    assert len(got) == len(rows) and len(weights) > 5
    texts = dict(rows)
    for r in got:
        if r.doc_id != 905:
            want = plain_score(texts[r.doc_id], weights, model[2])
            assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.5), (r.doc_id, r.score, want)


def test_training_is_bounded_in_bytes(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows + [(1000, "long " * 200_000)], "doc_id long, text string")
    seen = spark.createDataFrame(labels + [(1000, 1)], "doc_id long, toxic int")
    few, every = train(docs, seen, most_bytes=20_000), train(docs, seen)
    assert 0 < len(few[0]) < len(every[0])
    assert len(train(docs, seen, most_bytes=0)[0]) == 0


def test_training_brings_no_text_to_the_driver(spark, monkeypatch):
    """The model is that of texts at hand, but the driver gets numbers only."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows + rows[:3] + [(2000, None)], "doc_id long, text string")
    seen = spark.createDataFrame(labels + [(2000, 0)], "doc_id long, toxic int")
    names = []
    for method in ("collect", "toPandas", "toArrow"):
        was = getattr(DataFrame, method)
        monkeypatch.setattr(DataFrame, method, lambda self, was=was: names.append(self.columns) or was(self))
    got = train(docs, seen)
    monkeypatch.undo()
    assert names and not any("text" in n for n in names)
    table = docs.join(seen, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy("doc_id", "text").collect()
    want = fit([r.text or "" for r in table], [r.toxic for r in table])
    assert len(want[0]) > 5 and got[0].tolist() == want[0].tolist()
    assert np.allclose(got[1], want[1], rtol=1e-9) and got[2] == pytest.approx(want[2])


def test_a_long_first_text_does_not_end_the_sample(spark):
    rows, labels = corpus(300)
    first = spark.range(1000, 3000).orderBy(F.xxhash64("id")).where(F.crc32(F.col("id").cast("string")) % 5 != 0).first().id
    docs = spark.createDataFrame(rows + [(first, "long " * 200_000)], "doc_id long, text string")
    seen = spark.createDataFrame(labels + [(first, 1)], "doc_id long, toxic int")
    bound = sum(len(t) for _, t in rows)
    assert sorted(train(docs, seen, most_bytes=bound)[0]) == sorted(train(docs.where(F.col("doc_id") < 1000), seen)[0])


def test_one_kind_of_label_warns(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="both kinds"):
        assert {r.predicted for r in toxicity(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")).collect()} == {0}


def test_quality_on_the_stored_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    told = toxicity(docs, labels, locate=False).where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).join(labels, "doc_id").collect()
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in told if a.toxic == 1 for b in told if b.toxic == 0]
    assert len(pairs) > 100 and sum(pairs) / len(pairs) > 0.95
