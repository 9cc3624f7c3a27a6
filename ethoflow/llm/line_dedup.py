"""Line deduplication: lines that many documents share go, in every document or in all but the first.

Two Bloom filters of line hashes, seen once and seen twice, are filled where the texts lie: a task adds a hash to
the second if the first has it already. The filters of all tasks are merged in chunks (what two tasks saw once is seen
twice), and the merged second one comes back to the tasks, at most ``filter_bytes`` large. Only lines that it
holds shuffle: their keys are counted exactly, as text, and the first occurrence is chosen there. A filter that is too small
for its input has more suspects, never other results.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import WHITE, coefficients, mix
from .shared import BROADCAST_BYTES, released, small_batches, text_buffers, text_slices, written

#: Bits set for each hash, bits for each line where the bound allows them, and bits of a chunk of a filter.
PROBES, BITS_A_LINE, CHUNK = 4, 16, 1 << 18
#: A filter takes this many bytes at most.
FILTER_BYTES = 32 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes of keys that are hashed at once, and the period of a byte's weight in long keys.
_BLOCK, _PERIOD = 1 << 20, 1 << 16


class Lines:
    """The lines of some texts: text, byte range of line and key, and a hash of the key (0 bytes: no key)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_chars: int = 1):
        feeds = np.flatnonzero(data == 0x0A)
        per = np.diff(np.searchsorted(feeds, offsets)) + 1
        #: lines before each text, and in all
        self.first = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        n = int(self.first[-1])
        self.text = np.repeat(np.arange(len(per)), per)
        opening, closing = np.zeros(n, bool), np.zeros(n, bool)
        opening[self.first[:-1]] = closing[self.first[1:] - 1] = True
        self.start, self.end = np.empty(n, np.int64), np.empty(n, np.int64)
        self.start[opening], self.start[~opening] = offsets[:-1], feeds + 1
        self.end[closing], self.end[~closing] = offsets[1:], feeds
        self.low, a, b = _LOWER[data], self.start.copy(), self.end.copy()
        left = np.flatnonzero(a < b)
        while len(left := left[WHITE[data[a[left]]]]):
            a[left] += 1
            left = left[a[left] < b[left]]
        left = np.flatnonzero(a < b)
        while len(left := left[WHITE[data[b[left] - 1]]]):
            b[left] -= 1
        self.a, self.b = a, b
        chars = b - a
        if min_chars > 1:
            chars = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[np.stack([a, b])], axis=0)[0]
        self.keyed = chars >= max(min_chars, 1)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        size = self.b - self.a
        before = np.concatenate([[0], np.cumsum(size)])
        total = np.zeros(len(size), np.uint64)
        weights = coefficients(_PERIOD)
        for low in range(0, int(before[-1]), _BLOCK):
            high = min(low + _BLOCK, int(before[-1]))
            k = np.arange(np.searchsorted(before, low, "right") - 1, np.searchsorted(before, high, "left"))
            k = k[size[k] > 0]
            begin = np.maximum(before[k], low)
            length = np.minimum(before[k + 1], high) - begin
            at = np.concatenate([[0], np.cumsum(length)[:-1]])
            rank = np.arange(high - low) + np.repeat(begin - before[k] - at, length)
            told = (self.low[rank + np.repeat(self.a[k], length)].astype(np.uint64) + np.uint64(1)) * weights[rank & (_PERIOD - 1)]
            total[k] += np.add.reduceat(told, at)
        return mix(total + size.astype(np.uint64))

    def keys(self, lines: np.ndarray) -> pa.Array:
        """The keys of these lines as strings."""
        size = self.b[lines] - self.a[lines]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = np.arange(int(offsets[-1])) + np.repeat(self.a[lines] - offsets[:-1], size)
        return pa.LargeStringArray.from_buffers(len(lines), pa.py_buffer(offsets), pa.py_buffer(self.low[at]))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row for each probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(j) * step) & np.uint64(bits - 1) for j in range(PROBES)]).astype(np.int64)


def _holds(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


def _set(bitmap: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (places >> 3).ravel(), np.left_shift(1, places & 7).astype(np.uint8).ravel())


def _seen(batches, bits: int, min_chars: int):
    """One task: its two filters, as rows (chunk, once, twice) of packed chunks that aren't empty."""
    once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
    for whole in batches:
        for batch in text_slices(whole, "text"):
            lines = Lines(*text_buffers(batch.column(0)), min_chars)
            own, of = lines.hash[lines.keyed], lines.text[lines.keyed]
            if not len(own):
                continue
            order = np.argsort(own, kind="stable")  # of equal hashes the texts ascend
            own, of = own[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            last = np.concatenate([first[1:], [len(own)]]) - 1
            places = _places(own[first], bits)
            again = (of[first] != of[last]) | _holds(once, places)
            _set(twice, places[:, again])
            _set(once, places)
    wide = min(CHUNK, bits) >> 3
    some = np.flatnonzero(once.reshape(-1, wide).any(axis=1))
    for part in np.array_split(some, len(some) // 64 + 1) if len(some) else []:
        pack = lambda x: [zlib.compress(x[c * wide : (c + 1) * wide].tobytes(), 1) for c in part.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(pack(once), pa.binary()), pa.array(pack(twice), pa.binary())], names=["chunk", "once", "twice"])


def _merged(batches):
    """Rows in the order of chunks: the second filter of each, over all tasks. Two chunks are held, however many tasks there are."""
    now, once, twice = None, None, None
    told = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["chunk", "twice"])
    for batch in batches:
        for chunk, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if chunk != now:
                if now is not None:
                    yield told()
                now, once, twice = chunk, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if now is not None:
        yield told()


def seen_twice(docs: DataFrame, min_chars: int = 1, filter_bytes: int = FILTER_BYTES) -> np.ndarray:
    """The merged second filter: bits of every key that two rows of docs(text, ...) have, and of few others.

    Its size follows the number of lines, to ``filter_bytes`` at most, which bounds what the driver gathers.
    """
    lines = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
    bits = min(max(1 << (int(lines) * BITS_A_LINE).bit_length(), 1 << 12), 1 << (filter_bytes * 8).bit_length() - 1)
    chunks = docs.select("text").mapInArrow(lambda it: _seen(it, bits, min_chars), "chunk int, once binary, twice binary")
    merged = chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merged, "chunk int, twice binary")
    out, wide = np.zeros(bits >> 3, np.uint8), min(CHUNK, bits) >> 3
    for row in merged.toLocalIterator():
        out[row.chunk * wide : (row.chunk + 1) * wide] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return out


def _suspects(batches, twice: np.ndarray, min_chars: int):
    """Keys that the filter holds: a row for each key of a text, with its first line there."""
    for whole in batches:
        for batch in text_slices(whole, "text"):
            lines = Lines(*text_buffers(batch.column(2)), min_chars)
            hit = np.flatnonzero(lines.keyed)
            hit = hit[_holds(twice, _places(lines.hash[hit], len(twice) << 3))]
            if not len(hit):
                continue
            of = lines.text[hit]
            told = pa.table({"key": lines.keys(hit), "row": of, "line": hit - lines.first[of]}).group_by(["row", "key"]).aggregate([("line", "min")])
            own = told.column("row").combine_chunks()
            key = told.column("key").cast(pa.string())
            out = pa.table([key, batch.column(0).take(own), batch.column(1).take(own), told.column("line_min").cast(pa.int64())], names=["key", "doc_id", "mark", "line"])
            yield from out.to_batches(2000)


def _without(batches, dropped: dict[bytes, tuple] | None, min_chars: int):
    """(doc_id, n_lines, n_dropped, text): lines whose key is to go are left out, but for a first occurrence.

    The keys come from ``dropped`` (all texts alike), or from the row itself, in its columns gone and kept_lines.
    """
    if dropped is not None:
        hashes = np.sort(_key_hashes(dropped))
    for whole in batches:
        for batch in text_slices(whole, "text"):
            data, offsets = text_buffers(batch.column(2))
            lines = Lines(data, offsets, min_chars)
            gone = np.zeros(len(lines.text), bool)
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if dropped is None:
                own = [dict(zip(g or [], k or [])) for g, k in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
                some = np.flatnonzero(lines.keyed & np.array([bool(x) for x in own], bool)[lines.text])
            else:
                some = np.flatnonzero(lines.keyed)
                some = some[np.isin(lines.hash[some], hashes)]
            for k in some.tolist():
                t, key = int(lines.text[k]), lines.low[lines.a[k] : lines.b[k]].tobytes()
                if dropped is None:
                    stays = own[t].get(key.decode(), False)
                    gone[k] = stays is not False and stays != k - lines.first[t]
                elif (stays := dropped.get(key, False)) is not False:
                    gone[k] = stays != (ids[t], marks[t], k - int(lines.first[t]))
            n = np.bincount(lines.text[gone], minlength=batch.num_rows)
            texts = []
            for t in range(batch.num_rows):
                text = data[offsets[t] : offsets[t + 1]].tobytes()
                if n[t]:
                    stay = ~gone[lines.first[t] : lines.first[t + 1]]
                    text = b"\n".join(x for x, y in zip(text.split(b"\n"), stay.tolist()) if y)
                texts.append(text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(lines.first)), pa.array(n.astype(np.int64)), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def _key_hashes(keys) -> np.ndarray:
    data = b"\n".join(keys)
    return Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash


def line_dedup(docs: DataFrame, least_docs: int = 10, min_chars: int = 1, keep: str = "none", filter_bytes: int = FILTER_BYTES, limit: int = BROADCAST_BYTES, salt: int = 8) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and text (what stays) of every row of docs(doc_id, text, ...).

    A line's key: the line without white space (0x20, 0x09 to 0x0D) at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that ``least_docs`` rows (2 at least) or more hold lose their lines: all of them, or with
    ``keep="first"`` all but the first line of the smallest (doc_id, hash of the text), a null id before others. Rows of one
    id and one text are one there: each keeps that line. Null and empty texts are one empty line, which has no key.
    Each row counts as a document, also where ids repeat. Other columns are ignored.

    The repeated keys are broadcast while they take ``limit`` bytes at most; beyond, the suspects join them by
    key, each key dealt over ``salt`` tasks, and the texts are joined to their own lists.
    """
    if least_docs < 2 or keep not in ("none", "first"):
        raise ValueError("least_docs is 2 or more, keep is none or first")
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    twice = spark.sparkContext.broadcast(seen_twice(own, min_chars, filter_bytes))
    suspects = own.mapInArrow(lambda it: _suspects(it, twice.value, min_chars), "key string, doc_id long, mark long, line long")
    first = F.min(F.struct("doc_id", "mark", "line")) if keep == "first" else F.lit(None).cast("struct<doc_id:long,mark:long,line:long>")
    counted = suspects.groupBy("key").agg(F.count("*").alias("n"), first.alias("first"))
    gone = written(counted.where(F.col("n") >= least_docs).select("key", "first"), "repeated")
    size = gone.agg(F.sum(F.octet_length("key") + 96)).first()[0] or 0
    kind = "doc_id long, n_lines long, n_dropped long, text string"
    if size <= limit:
        dropped = {r.key.encode(): r.first and tuple(r.first) for r in gone.toLocalIterator()}
        released(gone)
        shared = spark.sparkContext.broadcast(dropped)
        return own.mapInArrow(lambda it: _without(it, shared.value, min_chars), kind)
    met = suspects.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(salt)))
    met = met.join(gone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))), ["key", "salt"])
    # equal rows of one id hold the same lines: one list for them; a list is no longer than its text
    here = F.when(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark")), F.col("first.line"))
    lists = met.select("key", "doc_id", "mark", here.alias("stays")).distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct("key", "stays")).alias("l"))
    lists = lists.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), F.col("l.key").alias("gone"), F.col("l.stays").alias("kept_lines"))
    told = own.join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left").select("doc_id", "mark", "text", "gone", "kept_lines")
    return told.mapInArrow(lambda it: _without(it, None, min_chars), kind)
