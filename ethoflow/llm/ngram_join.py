"""Exact Jaccard join of shingle sets by prefix filter and prefix trees, without enumerating groups of copies.

1. Texts become sets of 64-bit shingle hashes; texts of equal sets form one class (partial aggregation,
   so a group of copies never meets in one task). Only classes are joined.
2. Global order of shingles: a hash-chosen share of all shingles comes first, the rarest of them (counted
   over all classes) ahead; the rest follow in hash order. The share exceeds the prefix that the threshold
   needs, so counts of the share are enough; sets with too few of them add shingles of the rest. The prefix
   theorem holds for any total order, hence nothing is lost.
3. Prefix entries that nobody else has, or that length and positional bounds rule out against every size in
   their list (a list keeps the longest remainder for each size), are dropped. Every list names its most central set as hub, and a set goes to the blocks
   of its hubs; two sets with a common prefix shingle have a common hub. In a large block every set meets the
   hub first; what links with it is connected, and pairs of such sets aren't brought together again. Large blocks
   are cut into cells of like size, and only cells that sizes and longest remainders let link are brought together.
4. In a block the sets are stored in a prefix tree (shared heads once) and each set walks it, adding up
   overlap edge by edge and leaving a subtree as soon as overlap plus what can remain misses the bound.
   Sets already connected in the block aren't compared again; links form a forest.
5. Links of all blocks give connected components.

Equality of shingles is equality of their 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .hashing import Words, mix
from .shared import join_small, key_groups, released, text_buffers, text_slices, written

#: About the most sets of one chunk of a block, and their shingles (16 MB); a task holds two chunks at a time.
CHUNK, CHUNK_SHINGLES = 256, 1 << 21
SET_FIELDS = "doc_id long, n int, s1 long, s2 long, n0 int, toks array<long>, spare array<long>"


def _share(num: int, den: int) -> int:
    """Of 1024 parts of the hash space, those that come first: 1.2 times the longest relative prefix.

    Any share is exact, as sets with too few of its shingles add others; a larger one finds rarer shingles, and moves more.
    """
    return min(1024, int(1024 * 1.2 * (den - num) / den) + 1)


def _sets(batches, k: int, num: int, den: int):
    share = _share(num, den)
    for whole in batches:
        for batch in text_slices(whole, "text"):
            words = Words(*text_buffers(batch.column(1)), lower=True)
            n, s1, s2, n0, toks, spare = [], [], [], [], [], []
            for s in words.shingle_sets(k):
                size = len(s)
                low = (s & np.uint64(1023)) < share
                first = s[low]
                prefix = size - -(-num * size // den) + 1 if size else 0
                n.append(size)
                s1.append(int(np.bitwise_xor.reduce(s).view(np.int64)) if size else 0)
                s2.append(int(mix(s + np.uint64(size)).sum(dtype=np.uint64).view(np.int64)) if size else 0)
                n0.append(len(first))
                toks.append(first.view(np.int64))
                spare.append(s[~low][: max(0, prefix - len(first))].view(np.int64))
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in v])]).astype(np.int32), np.concatenate(v)) for v in (toks, spare)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n0, pa.int32()), *lists], names=["doc_id", "n", "s1", "s2", "n0", "toks", "spare"])


def _whole_sets(batches, k: int):
    for whole in batches:
        for batch in text_slices(whole, "text"):
            words = Words(*text_buffers(batch.column(1)), lower=True)
            sets = [s.tobytes() for s in words.shingle_sets(k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])


class PrefixTree:
    """Sets of ordered tokens, common heads stored once. A node: tokens of its edge, what can follow, children."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.root = self._node(order, 0)

    def _node(self, members: list[int], depth: int):
        """(edge tokens, longest remainder below, smallest size below, largest size below, sets that end here, children)"""
        first, last = self.sets[members[0]], self.sets[members[-1]]
        m = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:m] != last[depth:m])  # members are sorted: ends share what all share
        stop = depth + int(differ[0]) if len(differ) else m
        ended = [i for i in members if len(self.sets[i]) == stop]
        rest = [i for i in members if len(self.sets[i]) > stop]
        children, at = [], 0
        while at < len(rest):
            token, till = self.sets[rest[at]][stop], at
            while till < len(rest) and self.sets[rest[till]][stop] == token:
                till += 1
            children.append(self._node(rest[at:till], stop))
            at = till
        sizes = [self.sizes[i] for i in members]
        return first[depth:stop], max(len(self.sets[i]) for i in members) - stop, min(sizes), max(sizes), ended, children

    def links(self, probes, num: int, den: int, same):
        """Pairs (probe, stored set) of Jaccard >= num / den. same(p, i): true if the pair needn't be told."""
        width = max([0, *(int(s[-1]) + 1 for s in self.sets if len(s))])
        for p, tokens, size in probes:
            has = np.zeros(width, np.int32)
            has[tokens[tokens < width]] = 1
            left = int(has.sum())
            stack = [(self.root, 0, left)]
            while stack:
                (edge, below, least, most, ended, children), overlap, open_ = stack.pop()
                if den * least > 0 and (den * least * num > den * den * size or num * size > den * most):
                    continue  # every size below is too large or too small
                got = int(has[edge].sum())
                overlap += got
                open_ -= got
                low = max(least, -(-num * size // den))
                if (num + den) * (overlap + min(open_, below)) < num * (size + low):
                    continue  # remaining length can't reach the bound
                for i in ended:
                    if i != p and (num + den) * overlap >= num * (size + self.sizes[i]) and not same(p, i):
                        yield p, i
                stack += [(c, overlap, open_) for c in children]


def _hub_links(batches, num: int, den: int):
    """(hub, doc_id) of the sets that link with their hub, which comes first in its group."""
    for (hub, _), table in key_groups(batches, ["hub", "sub"]):
        if table.column("other")[0].as_py():
            continue  # no set of the hub
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        out = []
        for doc, s in zip(table.column("doc_id").to_pylist()[1:], sets[1:]):
            at = np.searchsorted(sets[0], s)
            common = int((sets[0][np.minimum(at, len(sets[0]) - 1)] == s).sum())
            if (num + den) * common >= num * (len(sets[0]) + len(s)):
                out.append(doc)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([hub] * len(out), pa.int64()), pa.array(out, pa.int64())], names=["hub", "doc_id"])


def _block_links(batches, num: int, den: int):
    for _, table in key_groups(batches, ["hub", "low", "high"]):
        ids = table.column("doc_id").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        chunk = table.column("chunk").to_pylist()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        sizes = [len(s) for s in sets]
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # tokens of many sets first: heads are shared; tokens of a single set can't overlap and are left out
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        keep = counts > 1
        cut = np.cumsum([0, *sizes])
        own = [inverse[a:b] for a, b in zip(cut, cut[1:])]
        ranked = [np.sort(rank[x[keep[x]]]) for x in own]
        parent = list(range(len(ids)))

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        stored = [i for i, c in enumerate(chunk) if c == low]
        probes = stored if low == high else [i for i, c in enumerate(chunk) if c == high]
        if not stored or not probes:
            continue
        tree = PrefixTree([ranked[i] for i in stored], [sizes[i] for i in stored])
        at = {i: k for k, i in enumerate(stored)} if low == high else {}
        a, b = [], []
        # a probe's place among the stored sets is the number that the tree knows it by
        for p, k in tree.links(((at.get(p, -1 - p), ranked[p], sizes[p]) for p in probes), num, den, lambda p, k: find(stored[p] if p >= 0 else -1 - p) == find(stored[k])):
            i, j = stored[p] if p >= 0 else -1 - p, stored[k]
            parent[find(i)] = find(j)
            a.append(ids[i])
            b.append(ids[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text, ...).

    Rows whose shingle sets have Jaccard similarity >= num / den are linked; component_id is the smallest
    doc_id that links reach. Null or empty texts, and texts without words, have an empty set, link with
    nothing and keep their own id. Rows with a null doc_id get a null component and link nothing. A doc_id
    that repeats gives a row each time; its rows count as separate texts. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sets = written(texts.mapInArrow(lambda it: _sets(it, k, num, den), SET_FIELDS), "sets")
    classes = (
        sets.where("n > 0 and doc_id is not null")
        .groupBy("s1", "s2")
        .agg(F.min(F.struct("doc_id", "n", "n0", "toks", "spare")).alias("c"))
        .select("s1", "s2", "c.*")
    )
    classes = written(classes, "classes")
    share = F.explode(F.concat(F.transform("toks", lambda t: F.struct(t.alias("tok"), F.lit(-1).alias("at"))), F.transform("spare", lambda t, i: F.struct(t.alias("tok"), i.cast("int").alias("at")))))
    tokens = classes.select("doc_id", "n", "n0", share.alias("t")).select("doc_id", "n", "n0", "t.tok", "t.at")
    shared = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    # a set's tokens that others have too, rarest first; those it has alone come before all of them
    mine = tokens.join(shared, "tok").groupBy("doc_id", "n", "n0").agg(
        F.collect_list(F.when(F.col("at") < 0, F.struct("df", "tok"))).alias("first"), F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "tok"))).alias("rest")
    )
    prefix = f"(n - ({num} * n + {den - 1}) div {den} + 1)"
    entries = (
        mine.withColumn("lone", F.expr("n0 - size(first)"))
        .withColumn("first", F.expr(f"slice(array_sort(first), 1, cast(greatest(0, {prefix} - lone) as int))"))
        .select("doc_id", "n", F.explode(F.expr("concat(transform(first, (x, i) -> struct(x.tok as tok, cast(lone + i as int) as i)), transform(rest, x -> struct(x.tok as tok, cast(n0 + x.at as int) as i)))")).alias("e"))
        .select("doc_id", "n", "e.tok", "e.i")
    )
    entries = written(entries, "entries")
    both = num + den
    # of each list: for every band of set sizes the least size and the longest remainder, and the most central set.
    # Bands are a twentieth of e apart, so a list has some hundred at most.
    sized = entries.groupBy("tok", F.floor(20 * F.ln("n")).alias("band")).agg(
        F.count("*").alias("c"), F.min("n").alias("n"), F.max(F.expr("n - i")).alias("r"), F.min(F.struct((F.col("i") * 1000 / F.col("n")).cast("int").alias("p"), "doc_id")).alias("hub")
    )
    lists = (
        sized.groupBy("tok")
        .agg(F.sum("c").alias("c"), F.collect_list(F.struct("n", "r", "c")).alias("sizes"), F.min("hub").alias("hub"))
        .where("c > 1")
        .selectExpr("tok", "sizes", "hub.doc_id as hub")
    )
    hubs = (
        entries.join(lists, "tok")
        .where(f"exists(sizes, s -> (s.n <> n or s.c > 1) and {num} * (n + s.n) <= {both} * least(n - i, s.r))")
        .groupBy("hub", "doc_id", "n")
        .agg(F.max(F.expr(f"{both} * (n - i) - {num} * n")).alias("a"))
    )
    # sets u and v can link only if num * n_v <= a_u and num * n_u <= a_v
    hubs = written(hubs, "hubs")
    released(entries)
    blocks = hubs.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("held")).where("m > 1")
    blocks = written(blocks.withColumn("subs", F.expr(f"if(m > {chunk}, cast(ceil(greatest(m / {chunk}, held / {CHUNK_SHINGLES})) as int), 0)")), "blocks")
    large = blocks.where("subs > 0")
    wanted = hubs.join(blocks, "hub").select("doc_id").union(large.select("hub")).distinct()
    wanted = written(wanted, "wanted")
    found = join_small(texts, wanted, "doc_id", "left_semi", 16).mapInArrow(lambda it: _whole_sets(it, k), "doc_id long, shingles binary")
    found = written(found, "whole")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # in a large block each set meets the hub first. Those that link are connected, so only the others need
    # to meet all: a group of near copies takes time in proportion to its sets.
    members = hubs.join(large, "hub").select("hub", "doc_id", F.expr("cast(pmod(xxhash64(doc_id), subs) as int)").alias("sub"))
    centres = large.join(found, F.col("hub") == F.col("doc_id")).select("hub", "doc_id", F.explode(F.expr("sequence(0, subs - 1)")).alias("sub"), "shingles", F.lit(0).alias("other"))
    near = members.join(found, "doc_id").select("hub", "doc_id", "sub", "shingles", F.lit(1).alias("other")).unionByName(centres)
    near = near.repartition(parts, "hub", "sub").sortWithinPartitions("hub", "sub", "other").mapInArrow(lambda it: _hub_links(it, num, den), "hub long, doc_id long")
    near = written(near.distinct(), "near")
    # large blocks are cut into cells of like size, and those by hash; only cells that can link meet. A set goes
    # to each chunk that its own meets, so cells are few: narrow ones would hold a handful of sets each.
    cut = hubs.join(blocks.select("hub", "subs"), "hub").withColumnRenamed("subs", "s").join(near.withColumn("linked", F.lit(True)), ["hub", "doc_id"], "left")
    cut = cut.select("hub", "doc_id", "n", "a", F.coalesce("linked", F.lit(False)).alias("linked"), F.expr("if(s > 0, cast(floor(10 * ln(n)) as int), 0)").alias("nb"))
    cell = ["hub", "nb", "linked"]
    cells = cut.groupBy(*cell).agg(F.count("*").alias("c"), F.sum("n").alias("held"), F.min("n").alias("least"), F.max("a").alias("reach"))
    cells = written(cells.withColumn("subs", F.expr(f"cast(ceil(greatest(c / {chunk}, held / {CHUNK_SHINGLES})) as int)")), "cells")
    parts_of = cells.select(*cell, "least", "reach", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")).withColumn("chunk", F.xxhash64("nb", "linked", "sub"))
    other = parts_of.select("hub", F.col("chunk").alias("other"), F.col("least").alias("least_"), F.col("reach").alias("reach_"), F.col("linked").alias("linked_"))
    meets = parts_of.join(other, "hub").where(f"not (linked and linked_) and {num} * least_ <= reach and {num} * least <= reach_").select(*cell, "sub", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    placed = (
        cut.join(cells.select(*cell, "subs"), cell)
        .select(*cell, "doc_id", F.expr("cast(pmod(xxhash64(doc_id), subs) as int)").alias("sub"))
        .join(meets, [*cell, "sub"])
        .select("hub", "doc_id", "chunk", "low", "high")
    )
    links = (
        placed.join(found, "doc_id")
        .select("hub", "low", "high", "chunk", "doc_id", "shingles")
        .repartition(parts, "hub", "low", "high")
        .sortWithinPartitions("hub", "low", "high")
        .mapInArrow(lambda it: _block_links(it, num, den), "a long, b long")
    )
    links = written(links.union(near.where("hub <> doc_id")).distinct(), "links")
    released(hubs, blocks, wanted, found, near, cells)
    reached = components(links)
    labels = classes.join(reached, classes["doc_id"] == reached["node"], "left").select("s1", "s2", F.coalesce("component", "doc_id").alias("component_id"))
    out = sets.select("doc_id", "n", "s1", "s2").join(labels, ["s1", "s2"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
