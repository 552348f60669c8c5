"""Whether a session-batch is decided or judged, and what touched an open suggestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import ID_PREFIX
from ..settings import KEYS


def open_spans(steps: DataFrame) -> DataFrame:
    """Each suggestion with the batch that made it and the one that judged it, if any.

    A session has at most one suggestion per arm, so its groups are tiny.
    """
    made = F.when(F.col("kind") == "suggest", F.col("batch_id"))
    closed = F.when(F.col("kind") == "judge", F.col("batch_id"))
    return steps.groupBy("session_id", "suggestion_no", "injection_id").agg(
        F.min(made).alias("made_in"), F.min(closed).alias("closed_in")
    )


def _in_time() -> Column:
    """Whether a batch lies after the one that suggested and not after the one that judged."""
    return (F.col("batch_id") > F.col("made_in")) & (
        F.col("closed_in").isNull() | (F.col("batch_id") <= F.col("closed_in"))
    )


def split_phases(session_batches: DataFrame, steps: DataFrame) -> DataFrame:
    """The phase of each session-batch: ``judge`` while a suggestion is open, else ``decide``.

    Spans of one session do not overlap, so each session-batch meets at most one.
    """
    batches = session_batches.select(*KEYS)
    spans = open_spans(steps).drop("suggestion_no")
    inside = (batches["session_id"] == spans["session_id"]) & _in_time()
    return batches.join(spans, inside, "left").select(
        batches["batch_id"],
        batches["session_id"],
        F.when(F.col("injection_id").isNotNull(), "judge").otherwise("decide").alias("phase"),
        "injection_id",
    )


def direct_hits(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Events that touched an open suggestion, counted per session-batch and suggestion.

    Ids are counted per session-batch before the join, so a much-clicked id is one row there;
    ids of other elements are dropped before that.
    """
    touched = (
        rows.select(*KEYS, F.explode(F.array_distinct(F.array("tgt_id", "el_id"))).alias("id"))
        .where(F.col("id").startswith(ID_PREFIX))
        .groupBy(*KEYS, F.col("id").alias("injection_id"))
        .agg(F.count("*").alias("n_hits"))
    )
    spans = open_spans(steps).drop("suggestion_no")
    return (
        touched.join(spans, ["session_id", "injection_id"])
        .where(_in_time())
        .select(*KEYS, "injection_id", "n_hits")
    )
