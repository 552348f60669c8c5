"""The course of a session: which of its batches make a suggestion and which judge it.

When a session is decided and judged does not depend on which arm it gets. So the few batches that
matter, at most two per arm, are found by rounds of "the first batch after the last mark that
qualifies": the first batch of all suggests, the first one after it with a verdict judges, the first one
after that suggests again. Every round is a minimum over the session, and all rounds share one
shuffle and one sort; nothing is gathered but the marks. A session's rows, one per batch, pass through a
buffer that spills, so a session may have any number of batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import feedback

# A batch that matters: it makes suggestion n, or judges it (then with a reward).
MARK = (
    "STRUCT<batch_id: BIGINT, suggestion_no: INT, pre_velocity: DOUBLE, velocity: DOUBLE, "
    "reward: DOUBLE, device: STRING, buckets: ARRAY<INT>>"
)
INPUT = ("batch_id", "velocity", "has_exit", "hit_mask", "n_items", "device", "buckets")


def earned(suggestion_no: Column, before: Column) -> Column:
    """What a session-batch earns for an open suggestion; null leaves it open."""
    hit = F.getbit(F.col("hit_mask"), F.greatest(suggestion_no, F.lit(0))) == 1
    verdict = feedback.outcome(F.col("n_items"), hit, F.col("has_exit"))
    return feedback.reward(verdict, F.col("velocity"), before)


def _rounds(n_arms: int) -> list[tuple[str, Column]]:
    """Each mark as a column that is worked out from the one before: (batch_id, velocity)."""
    session = Window.partitionBy("session_id")
    here = F.struct("batch_id", "velocity")
    out, last = [], None
    for n in range(n_arms):
        later = F.lit(True) if last is None else F.col("batch_id") > F.col(f"{last}.batch_id")
        made = f"made_{n}"
        out.append((made, F.min(F.when(later, here)).over(session)))
        later = F.col("batch_id") > F.col(f"{made}.batch_id")
        verdict = earned(F.lit(n), F.col(f"{made}.velocity"))
        last = f"judged_{n}"
        out.append((last, F.min(F.when(later & verdict.isNotNull(), here)).over(session)))
    return out


def marks(summaries: DataFrame, n_arms: int) -> DataFrame:
    """The batches that matter, a row each: ``session_id`` and the fields of a mark."""
    rows = summaries.select("session_id", *INPUT)
    names = []
    for name, value in _rounds(n_arms):
        rows = rows.withColumn(name, value)
        names.append(name)
    at = F.col("batch_id")
    suggests = [F.when(at == F.col(f"made_{n}.batch_id"), n) for n in range(n_arms)]
    judges = [F.when(at == F.col(f"judged_{n}.batch_id"), n) for n in range(n_arms)]
    before = [F.when(at == F.col(f"judged_{n}.batch_id"), F.col(f"made_{n}.velocity")) for n in range(n_arms)]
    number = F.coalesce(*suggests, *judges)
    judged = F.coalesce(*judges)
    found = rows.withColumns({"suggestion_no": number, "judged": judged, "before": F.coalesce(*before)})
    return found.where(F.col("suggestion_no").isNotNull()).select(
        "session_id",
        "batch_id",
        "suggestion_no",
        F.coalesce("before", "velocity").alias("pre_velocity"),
        "velocity",
        F.when(F.col("judged").isNotNull(), earned(F.col("judged"), F.col("before"))).alias("reward"),
        "device",
        "buckets",
    )


def courses(summaries: DataFrame, n_arms: int) -> DataFrame:
    """``session_id`` and its ``marks`` in order, at most two per arm."""
    fields = ("batch_id", "suggestion_no", "pre_velocity", "velocity", "reward", "device", "buckets")
    gathered = F.sort_array(F.collect_list(F.struct(*fields)))
    return marks(summaries, n_arms).groupBy("session_id").agg(
        gathered.cast(f"array<{MARK}>").alias("marks")
    )
