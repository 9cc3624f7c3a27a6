"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels.

A sentence's score is a logistic function of its hashed words and word beginnings; a document is toxic with
probability 1 - prod(1 - score). Only document labels are known, so the gradient reaches a sentence
through its document. Training reads a bounded sample of labelled rows (``most_labelled`` rows and ``most_bytes``
bytes of text, picked by a hash of the id); scoring reads every row once, without a shuffle.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, coefficients, mix
from .shared import released, small_batches, text_buffers, text_slices, written

#: Hashed features: 2**BITS, of words and of their first so many bytes.
BITS, BEGINNINGS = 22, (4, 5, 6, 7, 8, 9)
#: Labelled rows that training reads at most.
MOST_LABELLED = 12_000
#: Bytes of their texts, together.
MOST_BYTES = 64 << 20
#: Bytes of them that a task of training reads, about.
TASK_BYTES = 4 << 20
#: A sentence without any telling word has this logit before training, which is held near it.
PRIOR = -9.0
#: A sentence ends with one of these bytes ('.', '!', '?', line feed), or after this many words.
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True
SENTENCE = 40


class Sentences:
    """Words of some texts, the sentence of each, and their features: one row for words, one for each beginning."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        gap = np.zeros(256, bool)
        gap[:0x30] = gap[0x3A:0x41] = gap[0x5B:0x61] = gap[0x7B:0x80] = True
        gap[0x41:0x5B] = False
        self.words = w = Words(data, offsets, lower=True, white=gap)
        n = len(w.hash)
        self.n_texts = len(offsets) - 1
        ended = np.concatenate([[0], np.cumsum(_ENDS[data])])
        fresh = np.ones(n, bool)
        if n:
            fresh[1:] = (w.text[1:] != w.text[:-1]) | (ended[w.start[1:]] != ended[w.end[:-1]])
            first = np.flatnonzero(fresh)
            rank = np.arange(n) - first[np.cumsum(fresh) - 1]
            fresh |= rank % SENTENCE == 0
        self.first = np.flatnonzero(fresh)
        self.sentence = np.cumsum(fresh) - 1
        self.text = w.text[self.first]
        low = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint64)
        low = np.concatenate([low, np.zeros(max(BEGINNINGS), np.uint64)])
        rows = [w.hash]
        begun = np.zeros(n, np.uint64)
        for j, c in enumerate(coefficients(max(BEGINNINGS))):
            begun += (low[w.start + j] + np.uint64(1)) * c
            if j + 1 in BEGINNINGS:
                rows.append(np.where(w.end - w.start > j + 1, mix(begun + np.uint64(j)), w.hash))
        #: a word that is no longer than a beginning counts as the word again
        self.features = [(r >> np.uint64(64 - BITS)).astype(np.int64) for r in rows]

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        told = np.zeros(len(self.sentence))
        for f in self.features:
            told += weights[f]
        logit = bias + np.bincount(self.sentence, told, minlength=len(self.first))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def noisy_or(self, scores: np.ndarray) -> np.ndarray:
        return -np.expm1(np.bincount(self.text, np.log1p(-np.minimum(scores, 1 - 1e-12)), minlength=self.n_texts))


def _pieces(texts: list[str], most: int = 1 << 20):
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(t.encode())
        size += len(held[-1])
        if size > most or len(held) >= 500:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sentences(encoded: list[bytes]) -> Sentences:
    return Sentences(np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)]))


def _held(s: Sentences, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of some texts, and how many of the toxic and of the clean ones hold each."""
    own = s.text[s.sentence].astype(np.int64) << BITS
    seen = np.unique(np.concatenate([own | f for f in s.features]))
    mine = toxic[seen >> BITS]
    features, at = np.unique(seen & ((1 << BITS) - 1), return_inverse=True)
    return features, np.bincount(at[mine], minlength=len(features)), np.bincount(at[~mine], minlength=len(features))


def _hits(s: Sentences, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentence and number of each chosen feature that is said, feature row by feature row."""
    number = np.full(1 << BITS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    hits = [np.flatnonzero(number[f] >= 0) for f in s.features]
    return np.concatenate([s.sentence[h] for h in hits]), np.concatenate([number[f[h]] for f, h in zip(s.features, hits)])


def fit(texts: list[str], labels: list[int], rounds: int = 400, rate: float = 0.3):
    """(features, weights, bias) from texts at hand; ``train`` does the same where they lie.

    Features are screened first: at least three toxic documents hold one, and its share of toxic documents
    is four times that of clean ones. All others keep the weight 0.
    """
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():  # one class only: nothing tells sentences apart
        return _nothing(y)
    held = np.zeros((2, 1 << BITS), np.int32)
    at = 0
    for piece in _pieces(texts):
        features, bad, good = _held(_sentences(piece), y[at : at + len(piece)] > 0)
        held[1][features] += bad.astype(np.int32)
        held[0][features] += good.astype(np.int32)
        at += len(piece)
    toxic, clean = y.sum(), len(y) - y.sum()
    chosen = np.flatnonzero((held[1] >= 3) & (held[1] / toxic >= 4 * (held[0] + 0.5) / clean))
    rows, columns, of, base, at = [], [], [], 0, 0
    for piece in _pieces(texts):
        s = _sentences(piece)
        hit, number = _hits(s, chosen)
        rows.append(hit + base)
        columns.append(number)
        of.append(s.text + at)
        base += len(s.first)
        at += len(piece)
    rows, columns, of = (np.concatenate(v) for v in (rows, columns, of))
    return chosen, *_descent(y, rows, columns, of, len(chosen), rounds, rate)


def _nothing(y: np.ndarray):
    return np.zeros(0, np.int64), np.zeros(0), PRIOR if not len(y) or y.max() == 0 else -PRIOR


def _descent(y: np.ndarray, rows: np.ndarray, columns: np.ndarray, of: np.ndarray, k: int, rounds: int = 400, rate: float = 0.3):
    """(weights, bias) by full-batch Adagrad on the noisy-or likelihood of documents: sentence rows[i] says feature columns[i],
    and sentence j is one of document of[j], whose label is y."""
    base, toxic = len(of), y.sum()
    clean = len(y) - toxic
    weights, bias = np.zeros(k), PRIOR
    mass = np.where(y > 0, 0.5 / toxic, 0.5 / clean)
    squares, bias_squares = np.full(k, 1e-8), 1e-8
    for _ in range(rounds):
        logit = np.clip(bias + np.bincount(rows, weights[columns], minlength=base), -30, 30)
        p = 1 / (1 + np.exp(-logit))
        doc = np.clip(-np.expm1(np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))), 1e-9, 1 - 1e-9)
        # slope of the loss by a sentence's logit: its score times 1 if clean, -(1 - doc) / doc if toxic
        pull = p * (mass * np.where(y > 0, -(1 - doc) / doc, 1))[of]
        slope = np.bincount(columns, pull[rows], minlength=k) + 1e-6 * weights
        squares += slope**2
        weights -= rate * slope / np.sqrt(squares)
        bias_slope = pull.sum() + 0.01 * (bias - PRIOR)
        bias_squares += bias_slope**2
        bias -= 0.05 * bias_slope / np.sqrt(bias_squares)
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_bytes: int = MOST_BYTES):
    """The model from documents with a label and crc32(doc_id) mod 5 other than 0.

    They are a sample picked by hash: ``most_labelled`` labels at most, and of their documents, in the order of the hash,
    each whose text still fits in ``most_bytes`` with those before it; a text that doesn't fit is passed over, and the next one is
    looked at. Both bound the sample; texts are taken whole. They stay in the tasks, which count features and then look up the
    chosen ones: the driver gets the latter's places in sentences, and no text. A sample of one kind only warns: nothing can be learnt.
    """
    own = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    n = own.count()
    if n > most_labelled:
        # a share by hash, then the exact bound: the few rows that the top-k sees are ids and labels only
        own = own.withColumn("_r", F.xxhash64("doc_id")).orderBy("_r", "doc_id").limit(most_labelled).drop("_r")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")
    rows = rows.select("doc_id", "toxic", "text", F.xxhash64("doc_id").alias("r"), F.xxhash64("text").alias("mark"))
    # most_labelled rows of numbers at most come to the driver, which skips the texts that no longer fit
    sizes = rows.select("r", "doc_id", "mark", F.octet_length("text").alias("size")).orderBy("r", "doc_id", "mark").limit(most_labelled).collect()
    kept, total = set(), 0
    for row in sizes:
        if total + row["size"] <= most_bytes:
            total += row["size"]
            kept.add((row.doc_id, row.mark))
    if not kept:
        return _unlike(np.zeros(0))
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame(sorted(kept), "doc_id long, mark long"))
    sample = rows.join(small, ["doc_id", "mark"]).select("text", "toxic", "doc_id", "mark").repartition(1 + total // TASK_BYTES)
    sample = table = written(sample, "labelled")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if sum(n.values()) > most_labelled:  # rows of one id and text beyond the bound
        sample = sample.orderBy("doc_id", "text").limit(most_labelled)
        n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        released(table)
        return _unlike(np.array([float(x) for x in n]))
    own = sample.select(F.col("toxic").cast("int").alias("toxic"), "text", F.col("doc_id"), "mark")
    held = own.mapInArrow(_held_in, "feature int, toxic int, clean int").groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum("clean").alias("good"))
    chosen = held.where((F.col("bad") >= 3) & (F.col("bad") / F.lit(float(n[1])) >= F.lit(4) * (F.col("good") + 0.5) / F.lit(float(n[0]))))
    chosen = np.sort(chosen.select("feature").toArrow().column(0).to_numpy()).astype(np.int64)  # 2**BITS at most, each in three documents
    shared = spark.sparkContext.broadcast(chosen)
    told = own.mapInArrow(lambda it: _hits_in(it, shared.value), "doc_id long, mark long, toxic int, n int, sentence binary, feature binary").orderBy("doc_id", "mark").toArrow()
    released(table)
    sizes = told.column("n").to_numpy()
    numbers = lambda c: [np.frombuffer(x.as_buffer(), np.int32) for x in told.column(c) if x.is_valid]
    first = np.cumsum(sizes) - sizes
    rows = np.concatenate([x + b for x, b in zip(numbers("sentence"), first.tolist())]).astype(np.int64)
    columns = np.concatenate(numbers("feature")).astype(np.int64)
    y = told.column("toxic").to_numpy().astype(float)
    return chosen, *_descent(y, rows, columns, np.repeat(np.arange(len(y)), sizes), len(chosen))


def _unlike(y: np.ndarray):
    warnings.warn("toxicity: no labelled texts of both kinds, so all documents score alike", stacklevel=3)
    return _nothing(y)


def _held_in(batches):
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 20):
            counted = _held(Sentences(*text_buffers(batch.column(1))), batch.column(0).to_numpy() > 0)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in counted], names=["feature", "toxic", "clean"])


def _hits_in(batches, chosen: np.ndarray):
    """Of each text its number of sentences, and the sentence and number of every chosen feature in it (32 bits each)."""
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 20):
            s = Sentences(*text_buffers(batch.column(1)))
            sentence, feature = _hits(s, chosen)
            of = s.text[sentence]
            order = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[order], np.arange(s.n_texts + 1))
            n = np.bincount(s.text, minlength=s.n_texts)
            sentence = (sentence - (np.cumsum(n) - n)[of])[order].astype(np.int32)
            feature = feature[order].astype(np.int32)
            parts = [pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()) for x in (sentence, feature)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(0), pa.array(n.astype(np.int32)), *parts], names=["doc_id", "mark", "toxic", "n", "sentence", "feature"])


def _scored(batches, chosen: np.ndarray, told: np.ndarray, bias: float, locate: bool):
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = told
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 20):
            data, offsets = text_buffers(batch.column(1))
            s = Sentences(data, offsets)
            p = s.scores(weights, bias)
            doc = s.noisy_or(p)
            out = [batch.column(0), pa.array(np.where(np.isnan(doc), 0, doc))]
            if locate:
                w = s.words
                bad = np.flatnonzero(p >= 0.5)
                last = np.concatenate([s.first[1:], [len(w.hash)]]) - 1
                spans: list[list] = [[] for _ in range(batch.num_rows)]
                for k in bad.tolist():
                    t = int(s.text[k])
                    a, b = int(w.start[s.first[k]]), int(w.end[last[k]])
                    low = len(data[offsets[t] : a].tobytes().decode("utf-8", "replace"))
                    spans[t].append({"start": low, "stop": low + len(data[a:b].tobytes().decode("utf-8", "replace")), "score": float(p[k])})
                out.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "score", "sentences"][: len(out)])


def toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, model=None, locate: bool = True) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5) and offending sentences of every row of docs.

    sentences: code point ranges whose own score is 0.5 or more. A null or empty text, or one without
    words, scores 0. Repeated ids are scored row by row; a label given twice counts as toxic if any row is.
    Without usable labels of both kinds the score is constant. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen, weights, bias = train(docs, labels, most_labelled) if model is None else model
    shared = spark.sparkContext.broadcast((chosen, weights, float(bias)))  # 2**BITS numbers at most, whatever the input
    kind = "doc_id long, score double" + ", sentences array<struct<start:int,stop:int,score:double>>" * locate
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = own.mapInArrow(lambda it: _scored(it, *shared.value, locate), kind)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _clean(batches, at: int, chosen: np.ndarray, told: np.ndarray, bias: float):
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = told
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 20):
            s = Sentences(*text_buffers(batch.column(at)))
            yield batch.filter(pa.array(s.noisy_or(s.scores(weights, bias)) < 0.5))


def without_toxic(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """The rows of docs, with all their columns, that score below 0.5."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_labelled))
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _clean(it, at, *shared.value), docs.schema)
