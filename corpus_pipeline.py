"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

1. toxicity: documents that score 0.5 or more go.
2. near duplicates (5-word shingles, Jaccard 0.8): of each group the smallest doc_id stays (a null one last).
3. decontamination: documents with benchmark windows over a twentieth of their words go.
4. personal data: spans are masked by their kind.
5. pieces: ids of the text, and the text that they decode to.

Each row is a document of its own, also where doc_ids repeat or are null. Rows of one id and one text are copies: one
stays in stage 2 (all, if the text has no words, as such a text is like no other). Null texts pass, and become empty in
stage 5. Empty tables give empty tables. The first four stages keep all columns, the last returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethoflow.llm import decontaminate, ngram_join, pieces, pii, toxicity
from ethoflow.llm.rows import free_name, numbered, one_of_each
from ethoflow.llm.shared import join_small, released, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group; ids that repeat or are null don't join texts that differ, and equal rows count as copies."""
    number = free_name(docs, "number")
    rows, table = numbered(docs, number)
    groups = ngram_join.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), k=5, num=4, den=5)
    return one_of_each(rows, groups, number, table)


def _joined(docs: DataFrame, told: DataFrame, how: str, row_bytes: int) -> DataFrame:
    """docs and the rows of a written table that have their id (null meets null) and, as _mark, the hash of their text."""
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
    return join_small(docs, told, on, how, row_bytes)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go by their own text, whatever id they have or share."""
    judged = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    gone = judged.where(decontaminate.contaminated()).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    return _joined(docs, written(gone.distinct(), "gone"), "left_anti", 32).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own_id, mark, spans, held = (free_name(docs, x) for x in ("own_id", "mark", "spans", "held"))
    told = pii.personal_data(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(own_id), F.col("mark").alias(mark), F.col("spans").alias(spans))
    told = written(told.dropDuplicates([own_id, mark]), "spans")
    marked = docs.withColumn(held, F.xxhash64(F.coalesce("text", F.lit(""))))
    size = told.agg(F.sum(F.size(spans) * 40 + 48)).first()[0] or 0
    rows = max(told.count(), 1)
    on = F.col(own_id).eqNullSafe(F.col("doc_id")) & (F.col(mark) == F.col(held))
    found = join_small(marked, told, on, "left", -(-size // rows))
    text = F.when(F.col(spans).isNotNull(), pii.masked(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = pieces.tokens(docs)
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_fallback", "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("pieces", encode_pieces),
]

#: Training, Viterbi paths and components are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            released(before)
        before = docs
    return docs
