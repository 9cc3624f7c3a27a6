"""Ranked lexical search: the best documents for each item, by WAND over shards of documents.

One pass over the texts gives, for each document, its length and how often it has each term of the items; the
corpus counts come from that table. Then every task turns its documents into shards: an inverted index with the
exact impact of each posting, and each term's largest impact. For one item WAND's rule picks pivots: only a document whose
terms' largest impacts together reach the heap's threshold is scored. The rule is applied to a run of documents at a
time: lists whose largest impacts together stay below the threshold are never walked, only looked up for pivots of
the other lists. Heaps live on from shard to shard within a task, and the tasks' heaps are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import Words, separators
from .shared import BROADCAST_BYTES, released, small_batches, text_buffers, text_slices, written

#: What separates terms.
GAP = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: A shard has this many documents, or postings, at most (one document at least).
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 21
#: Documents of a shard's first run; each run is twice the last.
FIRST_RUN = 256


def _terms(texts: list[bytes]) -> Words:
    return Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), lower=True, white=GAP)


def _postings(batches, known: np.ndarray):
    """doc_id, n (terms with repeats) and the known terms of each text that has a term, with their counts.

    Terms are told by 64-bit hashes; ``known`` is sorted, and a term's number is its place in it.
    """
    told = np.zeros(1 << 16, bool)
    told[(known >> np.uint64(48)).astype(np.int64)] = True
    for whole in batches:
        for batch in text_slices(whole, "text"):
            words = Words(*text_buffers(batch.column(1)), lower=True, white=GAP)
            some = np.flatnonzero(told[(words.hash >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(known, words.hash[some])
            at[at == len(known)] = 0
            hit = known[at] == words.hash[some] if len(known) else np.zeros(0, bool)
            pair, count = np.unique(words.text[some[hit]].astype(np.int64) * max(len(known), 1) + at[hit], return_counts=True)
            n = np.diff(words.first)
            row = pair // max(len(known), 1)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))) for x in (pair % max(len(known), 1), count)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))


class Shard:
    """An inverted index of some documents: for each term its documents, in order, with their impacts."""

    def __init__(self, table: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        table = table.combine_chunks()
        ids = table.column("doc_id")
        self.nameless = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        m = 100 - 90 + (90 * table.column("n").to_numpy() * n_docs) // max(n_terms, 1)
        lists = table.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(m)), lists.value_lengths().to_numpy())
        term = lists.flatten().to_numpy()
        tf = table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.docs, self.impacts = doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        full = np.flatnonzero(self.first[1:] > self.first[:-1])
        if len(full):
            self.most[full] = np.maximum.reduceat(self.impacts, self.first[full])

    def search(self, terms: np.ndarray, heap: Heap) -> int:
        """Offers the documents that may enter the heap; returns how many were scored."""
        most = self.most[terms]
        terms = terms[np.argsort(-most, kind="stable")][: np.count_nonzero(most)]
        most = self.most[terms]
        #: rest[i]: what the lists from the i-th on can add at most
        rest = np.concatenate([np.cumsum(most[::-1])[::-1], [0]])
        lists = [(self.docs[a:b], self.impacts[a:b]) for a, b in zip(self.first[terms], self.first[terms + 1])]
        at = [0] * len(lists)
        low, run, scored, n = 0, FIRST_RUN, 0, len(self.ids)
        while low < n and rest[0] >= heap.bar:
            high = min(low + run, n)
            walked = int(np.count_nonzero(rest >= heap.bar))  # the lists from here on can't lift a document over the bar
            bound, score = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
            for k in range(walked):
                docs, impacts = lists[k]
                if at[k] < len(docs) and docs[at[k]] < low:
                    at[k] += int(np.searchsorted(docs[at[k] :], low))
                end = at[k] + int(np.searchsorted(docs[at[k] :], high))
                here = docs[at[k] : end] - low
                bound[here] += most[k]
                score[here] += impacts[at[k] : end]
                at[k] = end
            pivots = np.flatnonzero((bound > 0) & (bound + rest[walked] >= heap.bar))
            scored += len(pivots)
            total = score[pivots]
            for k in range(walked, len(lists)):
                stays = total + rest[k] >= heap.bar
                pivots, total = pivots[stays], total[stays]
                if not len(pivots):
                    break
                docs, impacts = lists[k]
                place = np.minimum(np.searchsorted(docs, pivots + low), len(docs) - 1)
                total = total + np.where(docs[place] == pivots + low, impacts[place], 0)
            heap.offer(total, self.ids[pivots + low], self.nameless[pivots + low])
            low, run = high, run * 2
        return scored


class Heap:
    """The best documents of an item so far: highest score, then smallest doc_id, a null id last."""

    def __init__(self, size: int):
        self.size, self.bar = size, 1
        self.score, self.ids, self.nameless = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, score: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        able = score >= self.bar
        if not able.any():
            return
        score, ids, nameless = (np.concatenate([a, b[able]]) for a, b in ((self.score, score), (self.ids, ids), (self.nameless, nameless)))
        best = np.lexsort((ids, nameless, -score))[: self.size]
        self.score, self.ids, self.nameless = score[best], ids[best], nameless[best]
        if len(best) == self.size:
            self.bar = int(self.score[-1])


def _shards(batches):
    held, docs, postings = [], 0, 0
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            piece = batch.slice(low, 1024)
            held.append(piece)
            docs += piece.num_rows
            postings += len(piece.column(2).flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield pa.Table.from_batches(held)
                held, docs, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _best(batches, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """One task's heaps: rows (item, doc_id, score)."""
    heaps = [Heap(k) for _ in items]
    for table in _shards(batches):
        shard = Shard(table, weights, n_docs, n_terms)
        for terms, heap in zip(items, heaps):
            shard.search(terms, heap)
    for low in range(0, len(items), 500):
        some = heaps[low : low + 500]
        item = np.repeat(np.arange(low, low + len(some)), [len(h.ids) for h in some])
        ids = pa.array(np.concatenate([h.ids for h in some]), pa.int64(), mask=np.concatenate([h.nameless for h in some]))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(np.concatenate([h.score for h in some]))], names=["item", "doc_id", "score"])


def _block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The search for a block of items whose texts the driver and each task can hold."""
    spark = docs.sparkSession
    texts: dict = {}
    for row in items.toLocalIterator():
        texts.setdefault(row[0], []).append(row[1].encode())
    names = list(texts)
    sets = [np.unique(_terms([b" ".join(texts[x])]).hash) for x in names]
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))
    shared = spark.sparkContext.broadcast(known)
    held = docs.mapInArrow(lambda it: _postings(it, shared.value), "doc_id long, n long, terms array<int>, counts array<int>")
    held = written(held, "postings")
    n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(known), np.int64)
    for row in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[row[0]] = row[1]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    asked = spark.sparkContext.broadcast(([np.searchsorted(known, s) for s in sets], weights))
    total = n_terms or 0
    best = written(held.mapInArrow(lambda it: _best(it, *asked.value, n_docs, total, k), "item int, doc_id long, score long"), "heaps")
    released(held)
    rows = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {items.schema[0].dataType.simpleString()}")
    return best.join(F.broadcast(rows), "item").select("item_id", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, limit: int = BROADCAST_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best of docs(doc_id, text, ...) for each of items(item_id, text, ...).

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that have a
    term, L terms in all (repeats counted), n in a document, df documents with a term and tf occurrences: a term's weight w is
    floor(1000 ln((2 N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, and a document scores the sum over the item's distinct terms of
    w ((10^9 tf) div (1000 tf + 8 m)). Only scores above 0 are told; equal scores go by doc_id, a null id last. Null and
    empty texts have no terms. Rows of docs are judged one by one, also where ids repeat (each has a rank). Rows of one
    item_id, null included, make one item of all their terms. An item that nothing matches has no rows. Other columns are ignored.

    Items are searched in blocks of about ``limit`` bytes of text, which is what the driver and the tasks hold of them.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(-(-size // max(limit, 1)), 1)
    out = None
    for b in range(n):
        some = _block(own, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) if n > 1 else asked, k)
        out = some if out is None else out.unionByName(some)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
