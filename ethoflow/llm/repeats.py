"""Passages that repeat: every window of ``length`` units (bytes or words) whose content occurs elsewhere.

1. Each window elects an anchor, the least hash among its runs of ``gram`` units (winnowing, Schleimer et
   al. 2003). The anchor is a function of the window's content, so equal windows have equal anchors at equal
   offsets. About two anchors are kept for each ``length`` units.
2. Anchors that occur once are dropped: no window of theirs repeats. Counting is a partial aggregate.
3. Each occurrence of a repeated anchor gives a stretch, the union of the windows that elect it. Equal
   stretches of one anchor form a class (count, first occurrence), again by partial aggregation: a passage in
   a third of all documents is one row for each map task.
4. Anchors with several classes go to shards: tasks that hold whole anchors and compare their classes with
   a suffix array or a suffix automaton (the caller's ``inspect``). Anchors with more than ``most`` classes,
   such as the edges of a very common passage, are split by window instead: windows are grouped by their
   own 128-bit digest, so no task holds one anchor's classes.
5. Covered ranges of classes are joined back to occurrences and gathered by document. Those of the commonest
   classes are broadcast, so no task gets all occurrences of a passage.

Anchors and classes are compared by 64-bit and 128-bit hashes; shards compare the units themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, coefficients, mix
from .shared import BROADCAST_BYTES, join_small, released, text_buffers, text_slices, written

U = np.uint64
#: Classes of one anchor that a shard takes; a stretch has 368 bytes at most, so they stay below 2 MB.
MOST = 4096
#: A place takes the low 28 bits beside its hash; longer texts (268 million bytes, or words) are an error.
_AT = U((1 << 28) - 1)


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, U)
    total, width = data.astype(U) + U(1), 1
    # hashes of doubling widths are combined, so the cost is logarithmic in gram; mixed once, at the end
    parts, left, at = [], gram, 0
    steps = coefficients(gram.bit_length())
    while left:
        if left & 1:
            parts.append((total, at, width))
            at += width
        left >>= 1
        if left:
            longer = total[: len(total) - width] * steps[width.bit_length() - 1]
            longer += total[width:]
            total = longer
            width *= 2
    have = np.zeros(n, U)
    for (part, at, width), c in zip(parts, coefficients(len(parts))):
        have += part[at : at + n] * c
    return mix(have)


def elected(grams: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int, gram: int):
    """Anchors of the windows of texts [start, stop): (place, first window, last window) in unit numbers."""
    wide = length - gram + 1
    n = len(grams)
    m = n - wide + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3
    if n > int(_AT):
        raise ValueError(f"a text of {n} units: places take 28 bits, so a text may have {int(_AT)} bytes (words) at most")
    keys = (grams & ~_AT) | np.arange(n, dtype=U)
    blocks = -(-n // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, U)
    padded[:n] = keys
    square = padded.reshape(blocks, wide)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[:m], ahead[wide - 1 : wide - 1 + m]) & _AT).astype(np.int64)
    valid = np.zeros(m + 1, np.int64)
    whole = stops - starts >= length
    np.add.at(valid, starts[whole], 1)
    np.add.at(valid, stops[whole] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(valid[:m]) > 0)
    if not len(windows):
        return (np.zeros(0, np.int64),) * 3
    chosen = least[windows]
    edge = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(windows)]]) - 1
    return chosen[first], windows[first], windows[last]


class Units:
    """A slice of texts as bytes or as words."""

    def __init__(self, column: pa.Array, words: bool, gram: int):
        self.data, offsets = text_buffers(column)
        if words:
            self.words = Words(self.data, offsets)
            self.starts, self.stops = self.words.first[:-1], self.words.first[1:]
            self.grams = self.words.runs(gram)
            self.counts = self.stops - self.starts
        else:
            self.words = None
            self.starts, self.stops = offsets[:-1], offsets[1:]
            self.grams = byte_grams(self.data, gram)
            self.counts = self.stops - self.starts

    def contents(self, low: np.ndarray, high: np.ndarray) -> list[bytes]:
        """The bytes of unit ranges; words are joined by one space."""
        if self.words is None:
            whole = self.data.tobytes()
        else:
            s, e = self.words.start, self.words.end
            length = e - s
            at = np.concatenate([[0], np.cumsum(length + 1)])
            line = np.full(int(at[-1]), 0x20, np.uint8)
            inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            line[np.repeat(at[:-1], length) + inside] = self.data[np.repeat(s, length) + inside]
            whole, low, high = line.tobytes(), at[low], at[high] - 1
        return [whole[a:b] for a, b in zip(low.tolist(), high.tolist())]


def _anchors(batches, words: bool, length: int, gram: int):
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 20):
            u = Units(batch.column(1), words, gram)
            place, _, _ = elected(u.grams, u.starts, u.stops, length, gram)
            text = np.searchsorted(u.starts, place, side="right") - 1
            number = np.arange(len(place)) - np.searchsorted(text, text)
            yield pa.RecordBatch.from_arrays([pa.array(u.grams[place].view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(number.astype(np.int32))], names=["h", "doc_id", "k"])


def _stretches(batches, words: bool, length: int, gram: int):
    """Occurrences of wanted anchors: h, digest, doc_id, pos, windows before the anchor, windows, content."""
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 20):
            u = Units(batch.column(1), words, gram)
            place, first, last = elected(u.grams, u.starts, u.stops, length, gram)
            text = np.searchsorted(u.starts, place, side="right") - 1
            # runs of wanted anchor numbers, flat, one list for each text
            runs = batch.column(2)
            flat = runs.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(runs.offsets)) // 2)
            base = np.searchsorted(text, owner)
            count = np.searchsorted(text, owner, side="right") - base
            marks = np.zeros(len(place) + 1, np.int64)
            np.add.at(marks, base + np.minimum(flat[:, 0], count), 1)
            np.add.at(marks, base + np.minimum(flat[:, 1], count), -1)
            take = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            for at in range(0, len(take), 20_000):
                j = take[at : at + 20_000]
                contents = u.contents(first[j], last[j] + length)
                digests = [xxhash.xxh3_128_digest(c) for c in contents]
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2) if len(j) else np.zeros((0, 2), np.int64)
                rows = pa.array(text[j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.grams[place[j]].view(np.int64)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch.column(0).take(rows), batch.column(3).take(rows)]
                    + [pa.array(x.astype(np.int32)) for x in (place[j] - u.starts[text[j]], place[j] - first[j], last[j] - first[j] + 1)]
                    + [pa.array(contents, pa.binary())],
                    names=_NAMES,
                )


_NAMES = ["h", "d1", "d2", "doc_id", "mark", "pos", "ahead", "windows", "content"]


def _window_digests(batches, words: bool, length: int):
    for batch in batches:
        names = batch.schema.names
        take = lambda k: batch.column(names.index(k)).to_pylist()  # noqa: B023, E731
        for h, d1, d2, doc, pos, n, content in zip(*map(take, ("h", "d1", "d2", "doc_id", "pos", "windows", "content"))):
            units = content.split(b" ") if words else content
            digests = [xxhash.xxh3_128_intdigest(b" ".join(units[o : o + length]) if words else units[o : o + length]) for o in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * n, pa.int64()) for x in (h, d1, d2, doc)] + [pa.array([pos] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([(x >> 64) - (1 << 63) for x in digests], pa.int64()), pa.array([(x & ((1 << 64) - 1)) - (1 << 63) for x in digests], pa.int64())],
                names=["h", "d1", "d2", "doc_id", "pos", "o", "w1", "w2"],
            )


def repeated_ranges(
    docs: DataFrame, words: bool, length: int, gram: int, inspect: Callable, keep_first: bool, most: int = MOST, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """(doc_id, mark, spans): flat unit ranges, by text, of windows that repeat.

    keep_first: of equal windows the first by (doc_id, place) stays; else all are told. ``inspect`` gets an
    iterator of batches of classes (h, d1, d2, n, ahead, windows, content), sorted by h and first occurrence, and
    yields (h, d1, d2, offs): offsets of windows that another (keep_first: an earlier) class of h holds.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null")
    anchors = written(texts.select("doc_id", "text").mapInArrow(lambda it: _anchors(it, words, length, gram), "h long, doc_id long, k int"), "anchors")
    # written, so that the join below is one of two plain shuffles, of which Spark splits large partitions
    again = written(anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "again")
    # sort-merge by name: these sides grow with the input, and a plan that broadcasts small ones tells nothing of large ones
    wanted = anchors.join(again.hint("merge"), "h").groupBy("doc_id").agg(F.array_sort(F.collect_set("k")).alias("k"))
    run = "filter(k, (x, i) -> i = 0 or k[i - 1] + 1 < x)"
    stop = "filter(k, (x, i) -> i = size(k) - 1 or k[i + 1] > x + 1)"
    wanted = written(wanted.select("doc_id", F.expr(f"flatten(zip_with({run}, {stop}, (x, y) -> array(x, y + 1)))").alias("at")), "wanted")
    size = wanted.agg(F.sum(F.size("at") * 4 + 32)).first()[0] or 0
    marked = texts.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    source = marked.join(F.broadcast(wanted) if size <= limit else wanted.hint("merge"), "doc_id").select("doc_id", "text", "at", "mark")
    kinds = "h long, d1 long, d2 long, doc_id long, mark long, pos int, ahead int, windows int, content binary"
    found = written(source.mapInArrow(lambda it: _stretches(it, words, length, gram), kinds), "stretches")
    released(anchors, again, wanted)
    key = ["h", "d1", "d2"]
    classes = written(found.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "ahead", "windows", "content")).alias("c")).select(*key, "n", "c.*"), "classes")
    # few anchors have more than ``most`` classes; the others go to shards with no join, so contents move once
    crowded = written(classes.groupBy("h").agg(F.count("*").alias("kinds")).where(f"kinds > {most}").select("h"), "crowded")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = (
        join_small(classes, crowded, "h", "left_anti", 16)
        .repartition(parts, "h")
        .sortWithinPartitions("h", "doc_id", "pos")
        .select(*key, "n", "ahead", "windows", "content")
        .mapInArrow(inspect, "h long, d1 long, d2 long, offs array<int>")
    )
    hot = join_small(classes, crowded, "h", "left_semi", 16).select(*key, "doc_id", "pos", "windows", "content").mapInArrow(lambda it: _window_digests(it, words, length), "h long, d1 long, d2 long, doc_id long, pos int, o int, w1 long, w2 long")
    hot = written(hot, "windows")
    best = hot.groupBy("w1", "w2").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "pos")).alias("best")).where("k > 1")
    mine = hot.join(best, ["w1", "w2"])
    if keep_first:
        mine = mine.where("best < struct(doc_id, pos)")
    told = told.union(mine.groupBy(key).agg(F.array_sort(F.collect_list("o")).alias("offs")))
    told = classes.select(*key, "n", F.col("doc_id").alias("doc0"), F.col("pos").alias("pos0")).join(told.hint("merge"), key, "left").where("n > 1 or size(offs) > 0")
    told = written(told, "told")
    released(classes, crowded, hot)
    # classes of more than a 4096th of all stretches are 4096 at most, with one number for each window: these
    # are broadcast, so a passage of a third of all documents isn't joined in one task; the others shuffle
    back = found.select(*key, "doc_id", "mark", "pos", "ahead", "windows")
    common = told.where(F.col("n") > max(back.count() / 4096, 1))
    if common.isEmpty():
        back = back.join(told.hint("merge"), key)
    else:
        common = F.broadcast(common)
        back = back.join(common, key).unionByName(back.join(common.select(key), key, "left_anti").join(told.hint("merge"), key))
    offs = F.coalesce("offs", F.array().cast("array<int>"))
    every = F.sequence(F.lit(0), F.col("windows") - 1)
    is_first = (F.col("doc_id") == F.col("doc0")) & (F.col("pos") == F.col("pos0"))
    offs = F.when(is_first, offs).otherwise(every) if keep_first else F.when(F.col("n") > 1, every).otherwise(offs)
    # neighbouring windows become one range: the start of a run is an offset whose predecessor is missing
    runs = F.expr("filter(offs, (x, i) -> i = 0 or offs[i - 1] + 1 < x)")
    ends = F.expr("filter(offs, (x, i) -> i = size(offs) - 1 or offs[i + 1] > x + 1)")
    spans = (
        back.withColumn("offs", offs)
        .where("size(offs) > 0")
        .select("doc_id", "mark", (F.col("pos") - F.col("ahead")).alias("low"), runs.alias("a"), ends.alias("b"))
        .select("doc_id", "mark", F.expr(f"flatten(zip_with(a, b, (x, y) -> array(low + x, low + y + {length})))").alias("r"))
    )
    spans = spans.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("r")).alias("spans"))
    spans = written(spans.mapInArrow(_merged_spans, "doc_id long, mark long, spans array<int>"), "spans")
    released(found, told)
    return spans


def _merged_spans(batches):
    for batch in batches:
        spans = [[x for r in merged(flat) for x in r] for flat in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32()))], names=["doc_id", "mark", "spans"])


def with_spans(docs: DataFrame, spans: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """shown, text, spans of every row of docs(doc_id, text, shown); spans null where nothing repeats."""
    size = spans.agg(F.sum(F.size("spans") * 4 + 40)).first()[0] or 0
    marked = docs.select("doc_id", "text", "shown", F.xxhash64("text").alias("mark"))
    return marked.join(F.broadcast(spans) if size <= limit else spans.hint("merge"), ["doc_id", "mark"], "left").select("shown", "text", "spans")


def merged(flat) -> list[tuple[int, int]]:
    """Flat ranges as disjoint maximal ranges, ascending."""
    out: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
