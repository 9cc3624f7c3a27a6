"""A trie of conversation prefixes: which conversations share their first turns, and what sharing saves.

A node is a distinct sequence of first turns, known by a 128-bit chained digest, so that rows hold no texts. Counts
and smallest members of nodes are plain aggregates with map-side sums. What follows from a subtree (leaves, saved bytes) is
rolled up in shards: nodes of at most ``most`` members hang in small subtrees under larger ones; each subtree goes whole to
one task, where numpy lays the tries of a shard out level by level (LOUDS bits and label arrays) and sums in reverse
order. The subtrees' totals pass to the nodes above, of at most ``most`` squared members, whose upper levels are again
shards of that form, and so on up to the root; so no shard grows with the input in width, and a round
sees only a fraction of the nodes of the last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_small, released, whole_groups, written

#: Members of a node whose subtree one task takes whole; powers of it divide the levels above.
MOST = 128
#: Conversation ids of a node that are joined into one text before they meet the others.
IDS = 4096
_ROW = "conv_id long, depth int, k1 long, k2 long, p1 long, p2 long, n_bytes long, last boolean"
_KEY, _PARENT = ["k1", "k2"], ["p1", "p2"]


def placed(turns: DataFrame, texts: bool = False) -> DataFrame:
    """(conv_id, pos, mark, n_bytes) of turns(conv_id, turn, role, text, ...): rows of conversations, in order.

    With ``texts`` role and text come along, for ``labelled``.
    Turns go by number (null first), then role, then text, so ties have one order; pos counts from 0. A null role or text is
    empty. Rows without conv_id are left out. mark is a 128-bit digest of role and text, n_bytes the text's UTF-8 bytes.
    """
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return own.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), _mark(F.col("role"), F.col("text")).alias("mark"), F.octet_length("text").cast("long").alias("n_bytes"), *["role", "text"] * texts)


def _mark(role: Column, text: Column) -> Column:
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.substring(whole, 1, 32))


def branched(rows: DataFrame, group: int = 5, cut: int = 9) -> DataFrame:
    """Conversations rebuilt as branches of others: the first h rows of conversation c - c % group, then c's own from h on.

    h is crc32 of c's decimal digits, modulo ``cut``. Fewer rows there are all taken; a missing conversation gives none.
    rows: as of ``placed``, which is also the form returned.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % cut
    heads = rows.where((F.col("conv_id") % group == 0) & (F.col("pos") < cut - 1)).withColumnRenamed("conv_id", "source")
    convs = rows.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("source"))
    taken = convs.join(heads, "source").where("pos < h").select(*rows.columns)
    return taken.unionByName(rows.where(F.col("pos") >= h))


def _chained(batches):
    """Rows in the order of conversations and places: a row for each prefix, the empty one first, with its key and its parent's."""
    conv, key, depth, held = None, (0, 0), 0, None
    out: list[tuple] = []

    def told():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

    for batch in batches:
        for c, mark, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if c != conv:
                if held is not None:
                    out.append((*held, True))
                conv, key, depth = c, (0, 0), 0
                held = (c, 0, 0, 0, None, None, 0)
            if mark is None:
                continue
            out.append((*held, False))
            digest = hashlib.blake2b(key[0].to_bytes(8, "big", signed=True) + key[1].to_bytes(8, "big", signed=True) + mark, digest_size=16).digest()
            own = (int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True))
            depth += 1
            held = (c, depth, *own, *key, size)
            key = own
            if len(out) >= 5000:
                yield told()
                out = []
    if held is not None:
        out.append((*held, True))
    if out:
        yield told()


_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in _ROW.split(", ")]


class Louds:
    """Tries under one root above them, by levels. bits: for each node, the root first, a 1 for each child and a 0.

    order: the input row of each node (the root has none); labels are arrays in that order. parent: read from the bits alone.
    """

    def __init__(self, keys: np.ndarray, parents: np.ndarray, roots: np.ndarray, depth: np.ndarray, conv: np.ndarray):
        n = len(depth)
        # equal pairs get equal numbers
        pairs = np.concatenate([keys, parents, roots])
        by = np.lexsort((pairs[:, 1], pairs[:, 0]))
        number = np.empty(3 * n, np.int64)
        number[by] = np.cumsum(np.concatenate([[0], (pairs[by[1:]] != pairs[by[:-1]]).any(axis=1)]))
        row = np.full(3 * n, -1, np.int64)
        row[number[:n]] = np.arange(n)
        top = row[number[2 * n :]] == np.arange(n)
        above = np.where(top, -1, row[number[n : 2 * n]])
        level = depth - depth[row[number[2 * n :]]]
        by = np.argsort(level, kind="stable")
        #: where each level begins, and the end; the root is node 0
        self.levels = np.concatenate([np.flatnonzero(np.diff(level[by], prepend=-1)), [n]]) + 1
        place = np.zeros(n + 1, np.int64)  # the last entry stands for the root, row -1
        self.order = np.empty(n, np.int64)
        for a, b in zip(self.levels[:-1], self.levels[1:]):
            rows = by[a - 1 : b - 1]
            rows = rows[np.lexsort((conv[rows], place[above[rows]]))]
            place[rows] = np.arange(a, b)
            self.order[a - 1 : b - 1] = rows
        children = np.bincount(place[above[self.order]], minlength=n + 1)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(children + 1) - 1] = False
        ones = np.flatnonzero(self.bits)
        self.parent = np.concatenate([[-1], ones - np.arange(n)])
        self.children = children

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values by node (the root's included), in reverse order of levels."""
        values = values.copy()
        for a, b in zip(self.levels[:-1][::-1], self.levels[1:][::-1]):
            np.add.at(values, self.parent[a:b], values[a:b])
        return values


def _rolled(batches):
    """Whole subtrees: n_children, n_leaves, saved and the parent's smallest member, of each node."""
    for table in whole_groups(batches, "r1"):
        col = lambda x: table.column(x).fill_null(0).to_numpy()  # noqa: E731, B023
        pair = lambda a, b: np.stack([col(a), col(b)], axis=1)  # noqa: E731, B023
        conv = col("conv_id")
        trie = Louds(pair("k1", "k2"), pair("p1", "p2"), pair("r1", "r2"), col("depth").astype(np.int64), conv)
        own = trie.order
        below = trie.children[1:] + col("children")[own]
        leaves = trie.summed(np.concatenate([[0], np.where(below == 0, 1, col("leaves")[own])]))[1:]
        saved = trie.summed(np.concatenate([[0], (col("n_convs")[own] - 1) * col("n_bytes")[own] + col("saved")[own]]))[1:]
        up = trie.parent[1:]
        parent = pa.array(np.where(up > 0, conv[own][np.maximum(up - 1, 0)], 0), mask=up == 0)
        fixed = [table.column(x).take(pa.array(own)).combine_chunks() for x in ("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs")]
        yield pa.RecordBatch.from_arrays([*fixed, pa.array(up == 0), parent, pa.array(below), pa.array(leaves), pa.array(saved)], names=_ROLLED_NAMES)


_ROLLED = "k1 long, k2 long, p1 long, p2 long, conv_id long, depth int, n_convs long, top boolean, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
_ROLLED_NAMES = [x.split()[0] for x in _ROLLED.split(", ")]


def _listed(batches):
    """Rows (k1, k2, conv_id) in order: ids of a node joined by commas, IDS at a time, with the first of them."""
    node, ids = None, []
    kind = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    told = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, ids[0], ",".join(map(str, ids))), kind)], names=["k1", "k2", "first", "ids"])
    for batch in batches:
        for a, b, conv in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (a, b) != node or len(ids) == IDS:
                if ids:
                    yield told()
                node, ids = (a, b), []
            ids.append(conv)
    if ids:
        yield told()


def _digested(batches):
    """Rows (k1, k2, first, ids) in order: SHA-256 of a node's ids joined by commas; one piece is held at a time."""
    node, digest, out = None, None, []
    told = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])
    for batch in batches:
        for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if (a, b) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(out) >= 2000:
            yield told()
            out = []
    if node is not None:
        out.append((*node, digest.hexdigest()))
        yield told()


def labelled(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turn (null at the root); rows: as given to ``prefix_trie``, with texts."""
    depth = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")).cast("long")
    last = rows.select("conv_id", depth.alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")


def ends(prefixes: DataFrame) -> DataFrame:
    """(k1, k2, first, ids): the conversations that end at a node, ascending, in pieces of at most IDS ids.

    Pieces are made where a range of (node, id) lies, so a node's many ids are spread over the tasks.
    """
    done = prefixes.where("last").select("k1", "k2", "conv_id")
    return done.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_listed, "k1 long, k2 long, first long, ids string")


def prefix_trie(rows: DataFrame, convs: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """The nodes of the trie of conversations given as rows(conv_id, pos, mark, n_bytes), as of ``placed``.

    convs(conv_id): conversations that may have no rows; they count as members of the root alone. Returns a row for each
    distinct sequence of first rows: k1, k2 (its key; the root is 0, 0), conv_id (smallest member), depth, parent_conv_id (of
    the parent; null for the root), n_convs (members), n_children, n_leaves (childless nodes of the subtree, the
    node included), saved_tokens (over the subtree: bytes of the node's last text, for each member but one) and
    ends_sha256 (of the ids of conversations that end here, numerically ascending, joined by commas). No conversations
    make no nodes, not even a root. Repeated convs count once; null ids are left out. Columns other than those named are ignored.

    One conversation's rows are read in order by one task, in batches; a node's members are never gathered but in
    pieces of ids, which one task digests one after the other, as SHA-256 asks.
    """
    own = rows.select("conv_id", "pos", "mark", "n_bytes")
    if convs is not None:
        own = own.unionByName(convs.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("long").alias("n_bytes")).distinct())
    prefixes = written(own.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_chained, _ROW), "prefixes")
    # a node's band: how often its number of members can be divided by most, until at most that many are left
    counts = prefixes.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > most)
    bounds = [most**k for k in range(1, 64) if most**k < 1 << 62]
    band = sum(((F.col("n") > x).cast("int") for x in bounds), F.lit(0))
    heavy = written(counts.select(*_KEY, band.alias("band")), "heavy")
    top = (heavy.agg(F.max("band")).first()[0] or 0) + 1
    banded = join_small(prefixes, heavy, _KEY, "left", 40).withColumn("band", F.coalesce("band", F.lit(0)))
    # the subtree of a node in its band begins where its conversations enter the band
    enter = Window.partitionBy("conv_id", "band").orderBy("depth")
    banded = banded.select("conv_id", "depth", *_KEY, *_PARENT, "n_bytes", "band", F.first("k1").over(enter).alias("r1"), F.first("k2").over(enter).alias("r2"))
    same = [F.min(c).alias(c) for c in ("conv_id", "depth", "p1", "p2", "n_bytes", "band", "r1", "r2")]  # all but conv_id are one value
    nodes = written(banded.groupBy(*_KEY).agg(F.count("*").alias("n_convs"), *same), "nodes")
    released(heavy)
    rolled, ups = [], None
    for b in range(top):
        part = nodes.where(F.col("band") == b)
        if ups is None:
            part = part.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            totals = ups.groupBy("p1", "p2").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved"))).withColumnsRenamed({"p1": "k1", "p2": "k2"})
            part = part.join(totals, _KEY, "left")
        shards = part.repartition("r1", "r2").sortWithinPartitions("r1", "r2")
        done = written(shards.mapInArrow(_rolled, _ROLLED), "rolled")
        rolled.append(done)
        mine = done.where("top and depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        ups = mine if ups is None else ups.unionByName(mine)
    whole = rolled[0]
    for more in rolled[1:]:
        whole = whole.unionByName(more)
    upper = nodes.where("band > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_up"))
    if top > 1:
        whole = join_small(whole, written(upper, "upper"), _PARENT, "left", 40).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    digests = ends(prefixes).repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digested, "k1 long, k2 long, ends_sha256 string")
    out = whole.join(digests, _KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(*_KEY, "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
