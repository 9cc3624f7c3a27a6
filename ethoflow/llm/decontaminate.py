"""Benchmark decontamination: which document words lie in a window of a benchmark item. DataFrame functions only.

A prefix-filtered join for exact containment: an item's windows are sets of shingles (here: single words,
each at its place); ordered by rarity over all documents, the prefix that containment makes necessary is
the one rarest word. Documents are joined by that word, positional and length bounds drop windows that would leave
the document, and the whole window is compared at its place. Texts are cut into words twice: to count words, and
to join them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, once A-Z are lower case.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words; without words an empty array."""
    text = F.coalesce(text, F.lit(""))
    # lower() is the fast way and right for ASCII; other texts keep their other capitals
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, _GAP), "")


def _kept(side: DataFrame, size: Column, limit: int) -> DataFrame:
    return F.broadcast(side) if (side.agg(F.sum(size)).first()[0] or 0) <= limit else side


def contamination(docs: DataFrame, items: DataFrame, length: int = 13, limit: int = BROADCAST_BYTES, salt: int = 32) -> DataFrame:
    """doc_id, n_words, n_hit, hits, item_ids (strings, sorted) and mark (xxhash64 of the text) of every row of docs(doc_id, text, ...).

    A window: ``length`` consecutive words of an item; an item of fewer words, but not none, is one window.
    n_hit counts document words inside any occurrence of a window; hits are the word ranges [start, stop) of
    the occurrences. Null texts have no words. Repeated doc_ids are judged row by row. A null item_id counts for
    n_hit and is in no list. Items that repeat count by id. Other columns are ignored.

    The prefixes are broadcast while their size, measured, is within ``limit`` bytes. Beyond it, places of
    prefix words shuffle without texts, each word dealt over ``salt`` tasks.
    """
    bench = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    windows = bench.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {length}, 0)), i -> slice(w, i + 1, {length}))")).alias("win"))
    # equal windows of several items are looked up once
    windows = written(windows.groupBy("win").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "windows")
    vocabulary = written(windows.select(F.explode("win").alias("word")).distinct(), "vocabulary")
    # rarity over all documents, of benchmark words only; a word no document has comes first
    said = docs.select(F.explode(words_of(F.col("text"))).alias("word"))
    counts = said.join(_kept(vocabulary, F.octet_length("word") + 32, limit), "word").groupBy("word").agg(F.count("*").alias("df"))
    counts = written(vocabulary.join(counts, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df")), "rarity")
    placed = windows.select("win", "items", F.posexplode("win").alias("off", "word")).join(counts, "word")
    rarest = placed.groupBy("win", "items").agg(F.min(F.struct("df", "word", "off")).alias("m")).where("m.df > 0")
    rarest = written(rarest.select(F.col("m.word").alias("word"), F.col("m.off").alias("off"), "win", "items"), "prefixes")
    bytes_of = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    size = rarest.agg(F.sum(bytes_of("win") + bytes_of("items") + F.octet_length("word") + 96)).first()[0] or 0
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), words_of(F.col("text")).alias("w"))
    # one pass over the words: place 0 is an empty word, no word of a text, whose row counts the others
    each = own.select("doc_id", "mark", "w", F.size("w").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word"))
    rows = rarest.unionByName(docs.sparkSession.createDataFrame([("", 0, None, None)], rarest.schema))
    if size <= limit:
        found = each.join(F.broadcast(rows), "word").where("win is null or pos - 1 >= off and pos - 1 - off + size(win) <= n and slice(w, pos - off, size(win)) = win").select("doc_id", "mark", "n", "pos", "off", "win", "items")
    else:
        keys = written(rarest.select("word").distinct(), "keys")
        lone = each.select("doc_id", "mark", "n", "pos", "word")
        some = lone.where("pos > 0").join(_kept(keys, F.octet_length("word") + 32, limit), "word", "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark", "pos"), F.lit(salt)))
        many = rarest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        places = some.join(many, ["word", "salt"]).where("pos - 1 >= off and pos - 1 - off + size(win) <= n")
        # candidates of a document gather, and only their places; its words come in once
        asked = places.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("pos", "off", "win", "items")).alias("c"))
        texts = own.withColumnRenamed("doc_id", "_d").withColumnRenamed("mark", "_m")
        met = texts.join(asked, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_m") == F.col("mark"))).select("doc_id", "mark", F.size("w").alias("n"), F.expr("filter(c, x -> slice(w, x.pos - x.off, size(x.win)) = x.win)").alias("c"))
        met = met.select("doc_id", "mark", "n", F.explode("c").alias("c")).select("doc_id", "mark", "n", "c.*")
        found = met.unionByName(lone.where("pos = 0").select("doc_id", "mark", "n", "pos", F.lit(0).alias("off"), F.lit(None).cast(rarest.schema["win"].dataType).alias("win"), F.lit(None).cast(rarest.schema["items"].dataType).alias("items")))
    start = F.col("pos") - 1 - F.col("off")
    hits = found.groupBy("doc_id", "mark").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count(F.when(F.col("win").isNull(), 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("win").isNotNull(), F.struct(start.alias("start"), (start + F.size("win")).alias("stop"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    covered = "aggregate(hits, struct(0 as total, 0 as end), (a, x) -> struct(a.total + greatest(0, x.stop - greatest(a.end, x.start)) as total, greatest(a.end, x.stop) as end), a -> cast(a.total as long))"
    out = hits.select("doc_id", "n_words", F.expr(covered).alias("n_hit"), "hits", "item_ids", "mark", "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
