"""Rows told apart where ids repeat or are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_small, written


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with a column ``name``, a number for each (doc_id, text), and the table of numbers that aren't the doc_id.

    A doc_id that is neither null nor repeated is its own number; where all are, there is no table. The others
    get numbers that no row has, in a written table (number, doc_id, mark, copies), mark being xxhash64 of the text.
    Rows of one id and one text share a number.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"))
    per = own.groupBy("doc_id").agg(F.count("*").alias("n"))
    odd = written(per.where("n > 1 or doc_id is null").select("doc_id"), "odd")
    if odd.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), None
    low, high = own.agg(F.min("doc_id"), F.max("doc_id")).first()
    if (high or 0) < 1 << 62:
        number = F.lit(max(high or 0, 0) + 1) + F.monotonically_increasing_id()
    elif low > -(1 << 62):
        number = F.lit(min(low, 0) - 1) - F.monotonically_increasing_id()
    else:
        raise ValueError("doc_ids leave no room for numbers")
    o = odd.withColumnRenamed("doc_id", "_o")
    rows = join_small(own, o, F.col("doc_id").eqNullSafe(F.col("_o")), "left_semi", 16)
    # numbers stand once they are written
    table = written(rows.groupBy("doc_id", "mark").agg(F.count("*").alias("copies")).withColumn("number", number), "numbers")
    t = table.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), F.col("number").alias("_n"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_m"))
    out = join_small(docs, written(t, "numbers"), on, "left", 48)
    return out.withColumn(name, F.coalesce("_n", F.col("doc_id").cast("long"))).select(*docs.columns, name), table


def one_of_each(docs: DataFrame, groups: DataFrame, number: str, table: DataFrame | None) -> DataFrame:
    """Of each group one row of docs: that of the smallest doc_id (null last), then of the smallest hash of its text.

    docs and table: as of ``numbered``; groups: (doc_id, n_shingles, component_id) of ``near_duplicates`` by number. Of rows
    of one id and one text one stays, unless their text has no words.
    """
    if table is None:
        gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_g")), "gone")
        return join_small(docs, gone, F.col(number) == F.col("_g"), "left_anti", 16).drop(number)
    t = table.select(F.col("number").alias("_n"), F.col("doc_id").alias("_d"), "mark", "copies")
    members = join_small(groups.where("n_shingles > 0").select("doc_id", "component_id").distinct(), t, F.col("doc_id") == F.col("_n"), "left", 48)
    real = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_d"))
    members = members.select("doc_id", "component_id", "copies", F.struct(real.isNull().alias("none"), real.alias("id"), "mark", F.col("doc_id").alias("n")).alias("s"))
    best = members.groupBy("component_id").agg(F.min("s").alias("s"))
    gone = members.select("doc_id").join(best.select(F.col("s.n").alias("doc_id")), "doc_id", "left_anti")
    gone = written(gone.select(F.col("doc_id").alias("_g")), "gone")
    left = join_small(docs, gone, F.col(number) == F.col("_g"), "left_anti", 16)
    twice = written(members.where("copies > 1").select(F.col("doc_id").alias("_g")), "copies")
    if twice.isEmpty():
        return left.drop(number)
    others = [c for c in left.columns if c != number]
    copy = free_name(left, "copy")
    same = join_small(left, twice, F.col(number) == F.col("_g"), "left_semi", 16)
    # few rows at most: those of one id and one text
    same = same.withColumn(copy, F.row_number().over(Window.partitionBy(number).orderBy(F.xxhash64(*others)))).where(F.col(copy) == 1)
    return join_small(left, twice, F.col(number) == F.col("_g"), "left_anti", 16).select(*others).unionByName(same.select(*others))
