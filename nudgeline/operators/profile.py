"""Raw inspection of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batch_profile(rows: DataFrame) -> DataFrame:
    """Messages and distinct sessions per batch; counted per session first, so that no task
    sees all rows of a batch."""
    per_session = rows.groupBy("batch_id", "session_id").agg(F.count("*").alias("n"))
    return per_session.groupBy("batch_id").agg(
        F.sum("n").alias("n_messages"), F.count("session_id").alias("n_sessions")
    )


def batch_sample(rows: DataFrame, order: str, size: int = 10) -> DataFrame:
    """First rows of each batch. The rank limit also runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("batch_id").orderBy(order))
    return rows.withColumn("row_no", rank).where(F.col("row_no") <= size)
