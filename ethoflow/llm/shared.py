"""What several operators need: shared storage, size-checked joins and grouped Arrow streams."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes, by its exact row count; beyond, the join shuffles.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the session's checkpoint directory.

    Where neither is set, a local master gets a temporary folder; on a cluster, whose executors would not see
    it, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ethoflow-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs no rerun.

    The table goes when ``released``, at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again, and lets Spark drop what it shuffled for them.

    Spark cleans shuffle files once the driver's collector finds their plans gone, by default half-hourly; here it
    is asked to look, so that the files of one step aren't kept beside those of the next.
    """
    for df in tables:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def join_small(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a side that is often small. ``small`` must be written: it is counted, and broadcast
    only when rows * row_bytes stays within ``limit``; else both sides shuffle on the key."""
    n = small.count()
    return big.join(F.broadcast(small) if n * row_bytes <= limit else small, on, how)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2000 rows in place of Spark's default of 10,000, for operators that pass whole texts to Python.

    A worker and its executor each hold a batch or two, so this is memory for every core. A session's own value stays.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) == 10_000:
        spark.conf.set(rows, "2000")


def text_slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Cuts a batch so that no piece holds more than ``most`` bytes of text (one row at least)."""
    import numpy as np

    k = batch.schema.get_field_index(column)
    sizes = np.diff(text_buffers(batch.column(k))[1])
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def text_buffers(column: pa.Array):
    """(bytes, offsets) of a string column; a null is an empty text."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    offsets = offsets.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets * 0
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def key_groups(batches, keys: list[str]):
    """From batches in which equal keys are neighbours: one table for each key, whole across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        marks = list(zip(*columns))
        first = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > first:
                    held.append(batch.slice(first, i - first))
                if held:
                    yield last, pa.Table.from_batches(held)
                held, first, last = [], i, mark
        held.append(batch.slice(first))
    if held:
        yield last, pa.Table.from_batches(held)


def whole_groups(batches, key: str):
    """Tables of many groups each, from batches in which equal keys are neighbours; no group is parted."""
    import numpy as np

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = table.column(key).to_numpy()
        edge = np.flatnonzero(keys[1:] != keys[:-1])
        if len(edge):
            yield table.slice(0, int(edge[-1]) + 1).combine_chunks()
            table = table.slice(int(edge[-1]) + 1)
        held = table
    if held is not None and held.num_rows:
        yield held.combine_chunks()
