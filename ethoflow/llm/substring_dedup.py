"""Removal of repeated byte strings (suffix arrays of shards) and of repeated word windows (suffix automata).

Both take candidates from ``repeats``: shards hold every stretch that can share a window, so a match never
needs two shards. A passage of near copies meets in the shards of its anchors only.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words
from .repeats import MOST, merged, repeated_ranges, with_spans
from .shared import BROADCAST_BYTES, key_groups, text_buffers, text_slices, whole_groups
from .suffix import SuffixAutomaton, permuted_common_prefixes, suffix_array

_OUT = ["h", "d1", "d2", "offs"]


def _told(rows):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=_OUT)


def _array_shards(batches, length: int, gram: int, shard: int):
    """Suffix array and permuted common prefixes of whole anchors' classes, about ``shard`` bytes at a time.

    A window reaches at least half of what it has beside its anchor to one side of it. So classes that share a
    window share the anchor with that much before it, or with that much after it; the others stay out.
    """
    half = (length - gram + 1) // 2
    held, size = [], 0
    for table in whole_groups(batches, "h"):
        # one class has nothing to meet, and classes of several occurrences are removed anyway
        table = table.filter(pa.array(_can_tell(table)))
        contents, ahead = table.column("content").to_pylist(), table.column("ahead").to_pylist()
        # a context holds the anchor, so equal ones are of one anchor
        before = [c[a - half : a + gram] if a >= half else None for c, a in zip(contents, ahead)]
        after = [c[a : a + gram + half] if len(c) - a >= gram + half else None for c, a in zip(contents, ahead)]
        left, right = Counter(before), Counter(after)
        keep = [x is not None and left[x] > 1 or y is not None and right[y] > 1 for x, y in zip(before, after)]
        table = table.filter(pa.array(keep, pa.bool_()))
        table = table.filter(pa.array(_can_tell(table)))
        rows = list(zip(*(table.column(k).to_pylist() for k in ("h", "d1", "d2", "windows", "content"))))
        at = 0
        for i, row in enumerate(rows):
            size += len(row[4]) + 1
            if size >= shard and (i + 1 == len(rows) or rows[i + 1][0] != row[0]):
                yield from _array_shard(held + rows[at : i + 1], length)
                held, size, at = [], 0, i + 1
        held += rows[at:]
    if held:
        yield from _array_shard(held, length)


def _can_tell(table: pa.Table) -> np.ndarray:
    """Which rows are of anchors with several classes, one of which occurs once."""
    h, n = table.column("h").to_numpy(), table.column("n").to_numpy()
    if not len(h):
        return np.zeros(0, bool)
    start = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    size = np.diff(np.concatenate([start, [len(h)]]))
    return np.repeat((size > 1) & (np.minimum.reduceat(n, start) == 1), size)


def _array_shard(rows, length: int):
    # texts are UTF-8, which has no byte 255: it parts the stretches, and 0 (no UTF-8 text needs it raised) ends
    joined = np.frombuffer(b"\xff".join(r[4] for r in rows), np.uint8)
    t = np.concatenate([np.where(joined == 255, 1, joined.astype(np.int64) + 2), [0]])
    order = suffix_array(t, 258)
    plain = np.concatenate([joined, np.zeros(1, np.uint8)])
    common = permuted_common_prefixes(plain, order, length)
    full = common >= length
    again = full.copy()
    before = order[:-1][full[order[1:]]]  # the neighbour in order has the same window
    again[before] = True
    out, at = [], 0
    for h, d1, d2, windows, content in rows:
        hit = np.flatnonzero(again[at : at + windows])
        if len(hit):
            out.append((h, d1, d2, hit.tolist()))
        at += len(content) + 1
    if out:
        yield _told(out)


def _automaton_shards(batches, length: int):
    """Each anchor's classes stream through the automaton of the classes before them."""
    out = []
    for (h,), table in key_groups(batches, ["h"]):
        if table.num_rows < 2:
            continue
        automaton, end = SuffixAutomaton(), -1
        for d1, d2, content in zip(*(table.column(k).to_pylist() for k in ("d1", "d2", "content"))):
            words = content.split(b" ")
            hit = [e - length + 1 for e, got in enumerate(automaton.matching(words)) if got >= length]
            if hit:
                out.append((h, d1, d2, hit))
            automaton.extend(words)
            automaton.extend((end,))  # no word: matches end here
            end -= 1
        if len(out) >= 5000:
            yield _told(out)
            out = []
    if out:
        yield _told(out)


def _cut_bytes(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 20):
            data, offsets = text_buffers(batch.column(1))
            n, removed, spans, digests = [], [], [], []
            for flat, a, b in zip(batch.column(2).to_pylist(), offsets, offsets[1:]):
                text, runs, at, h = data[a:b].tobytes(), merged(flat or ()), 0, hashlib.sha256()
                for low, high in runs:
                    h.update(text[at:low])
                    at = high
                h.update(text[at:])
                n.append(len(text))
                removed.append(sum(y - x for x, y in runs))
                spans.append(len(runs))
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in (n, removed, spans)), pa.array(digests, pa.string())], names=names)


def _cut_words(batches):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 20):
            words = Words(*text_buffers(batch.column(1)))
            data = text_buffers(batch.column(1))[0]
            n, removed, digests = [], [], []
            for i, flat in enumerate(batch.column(2).to_pylist()):
                low, high = int(words.first[i]), int(words.first[i + 1])
                runs, at, kept = merged(flat or ()), low, []
                for x, y in [*runs, (high - low, high - low)]:
                    kept += [data[a:b].tobytes() for a, b in zip(words.start[at : low + x].tolist(), words.end[at : low + x].tolist())]
                    at = low + y
                n.append(high - low)
                removed.append(sum(y - x for x, y in runs))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in (n, removed)), pa.array(digests, pa.string())], names=names)


def _keyed(docs: DataFrame, stand_in: bool) -> DataFrame:
    """doc_id, text, shown; with stand_in, rows without a doc_id get a number from their text in its place."""
    own = docs.select(F.col("doc_id").cast("long").alias("shown"), F.coalesce("text", F.lit("")).alias("text"))
    return own.select("shown", "text", (F.coalesce("shown", F.xxhash64("text", F.lit("stand-in"))) if stand_in else F.col("shown")).alias("doc_id"))


def byte_dedup(docs: DataFrame, length: int = 200, gram: int = 64, shard: int = 1 << 21, most: int = MOST, limit: int = 0) -> DataFrame:
    """Without every byte that a ``length``-byte string covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal runs removed) and kept_sha256 for each row of
    docs(doc_id, text, ...). A null text is empty. Repeated rows are copies of one another. Rows with a
    null doc_id take part as the others do. Other columns are ignored.

    What is joined to the texts, marks of anchors and spans, grows with them,
    so by default it is never broadcast: the texts move by doc_id at every size. ``limit`` bytes allow it.
    """
    own = _keyed(docs, True)
    spans = repeated_ranges(own, False, length, gram, lambda it: _array_shards(it, length, gram, shard), False, most, limit)
    return with_spans(own, spans, limit).mapInArrow(_cut_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def word_dedup(docs: DataFrame, length: int = 20, gram: int = 6, most: int = MOST, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Without every word that a window of ``length`` words covers which also starts earlier.

    Earlier: a smaller doc_id, or the same document and an earlier start. Returns doc_id, n_words,
    n_removed and kept_sha256 (kept words joined by one space) for each row of docs(doc_id, text, ...).
    A null text has no words. Rows that share a doc_id count as one document, ordered by start alone, so
    equal rows keep their first windows both. Rows with a null doc_id are returned whole and take no part.
    """
    own = _keyed(docs, False)
    spans = repeated_ranges(own, True, length, gram, lambda it: _automaton_shards(it, length), True, most, limit)
    return with_spans(own, spans, limit).mapInArrow(_cut_words, "doc_id long, n_words long, n_removed long, kept_sha256 string")
