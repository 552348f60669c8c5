"""What leaves the engine, as views of the step log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.feedback import label
from ..operators.choice import arm_name
from ..settings import Policy


def suggestions(steps: DataFrame, when: Column, policy: Policy = Policy()) -> DataFrame:
    """Suggestions to send (``schemas.SUGGESTION``) with their batch; ``when`` is its time."""
    return steps.where(F.col("kind") == "suggest").select(
        "batch_id",
        "session_id",
        arm_name(F.col("arm_idx"), policy).alias("component"),
        "injection_id",
        when.alias("timestamp"),
    )


def suggestion_messages(suggested: DataFrame) -> DataFrame:
    """The same as JSON message bodies."""
    fields = ("session_id", "component", "injection_id", "timestamp")
    return suggested.select(
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body")
    )


def metrics(steps: DataFrame, when: Column, policy: Policy = Policy()) -> DataFrame:
    """Performance rows (``schemas.METRICS``), one per judged suggestion."""
    return steps.where(F.col("kind") == "judge").select(
        "batch_id",
        when.alias("time"),
        "session_id",
        "device",
        arm_name(F.col("arm_idx"), policy).alias("action_chosen"),
        F.col("score").alias("model_confidence"),
        F.col("reward").alias("reward_received"),
    )


def training_examples(steps: DataFrame) -> DataFrame:
    """Vector and label of every judged suggestion."""
    return steps.where(F.col("kind") == "judge").select(
        "batch_id", "session_id", "arm_idx", "buckets", label(F.col("reward")).alias("label")
    )


def batch_summary(steps: DataFrame) -> DataFrame:
    """Suggestions and performance rows per batch."""
    return steps.groupBy("batch_id").agg(
        F.count_if(F.col("kind") == "suggest").alias("n_suggestions"),
        F.count_if(F.col("kind") == "judge").alias("n_metrics"),
    )
