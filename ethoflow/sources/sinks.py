"""Writers: frame and summary CSV, nested JSON results, parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.session import frame_export, rounded


def write_frame_csv(frames: DataFrame, path: str) -> None:
    """Frames as CSV under their own column names, rounded; nulls are empty, booleans 0 and 1."""
    rounded(frames).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_frame_file(frames: DataFrame, path: str, px_per_cm: float = 0.0, kps: str | None = None) -> None:
    """The per-frame CSV with its fixed columns, and landmarks where ``kps`` names their map."""
    frame_export(frames, px_per_cm, kps).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, by: str | None = None) -> None:
    (rows.write.mode("overwrite").partitionBy(by) if by else rows.write.mode("overwrite")).parquet(path)


def write_manifest(picks: DataFrame, path: str) -> None:
    """The rows of ``sampling.diverse`` as one CSV file with header, in the order in which they were taken; few by nature."""
    picks.orderBy("picked").drop("picked").coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
