"""The learning loop: batch by batch, decide or judge, then learn.

All sessions of a batch are scored with the models as they were when it began. The same function
serves a bounded replay and the micro-batches of a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..models import local_sgd, training
from ..models.scoring import scorer
from ..models.weights import ArmModel
from ..operators import choice, session_batch
from ..session import observed, remove
from ..settings import Policy
from . import lifecycle, outbox, outputs
from .ledger import Ledger

# A sink gets the batch's rows, None if there are none, and its id; it must replace what an earlier
# try left behind.
Sink = Callable[[DataFrame | None, int], None]

STATE_COLUMNS = (
    "seen",
    "open_arm",
    "suggestion_no",
    "score",
    "is_exploring",
    "pre_velocity",
    "buckets",
)


class _Prefixed:
    """Columns by attribute, under a common prefix."""

    def __init__(self, prefix: str):
        self._prefix = prefix

    def __getattr__(self, name: str) -> Column:
        return F.col(self._prefix + name)


def step(
    summaries: DataFrame, state: DataFrame, models: list[ArmModel], policy: Policy
) -> DataFrame:
    """The steps that one batch takes: a left join of its sessions with their state.

    Both sides have one row per session. Only sessions that get a suggestion are scored.
    """
    past = state.select("session_id", *[F.col(c).alias("past_" + c) for c in STATE_COLUMNS])
    known = summaries.join(past, "session_id", "left").withColumns(
        {
            "past_seen": F.coalesce("past_seen", F.lit(0)),
            "past_open_arm": F.coalesce("past_open_arm", F.lit(lifecycle.NONE_OPEN)),
        }
    )
    every_arm = (1 << len(policy.arms)) - 1
    decides = (F.col("past_open_arm") == lifecycle.NONE_OPEN) & (F.col("past_seen") != every_arm)
    scores = scorer(models, policy)(F.when(decides, F.col("buckets")))
    scored = known.withColumns({"scores": scores, **choice.draws(policy, F.col("session_id"), F.col("batch_id"))})
    batch, past = _Prefixed(""), _Prefixed("past_")
    decided = scored.withColumns(
        {
            "arm": lifecycle.chosen_arm(batch, past, policy),
            "reward": lifecycle.earned_reward(past),
        }
    ).where(F.col("arm").isNotNull() | F.col("reward").isNotNull())
    fields = lifecycle.step_fields(
        batch, past, F.col("arm"), F.col("reward"), F.col("session_id"), policy
    )
    return decided.select("session_id", *[value.alias(name) for name, value in fields.items()])


@dataclass(frozen=True)
class BatchReport:
    """What a batch came to; observed while its steps were written."""

    batch_id: int
    sessions: int
    suggestions: int
    judgements: int


class LearningLoop:
    """Runs batches of usable session-batches, one after the other.

    ``send`` gets the suggestion messages and ``record`` the performance rows of a batch. An
    error in either fails the batch before its commit, so it is tried again and nothing is lost.
    ``publish`` gets both as one table (``outbox.publisher``), so that they appear together.
    ``report`` gets the counts of every batch that was committed.
    """

    def __init__(
        self,
        ledger: Ledger,
        send: Sink | None = None,
        record: Sink | None = None,
        report: Callable[[BatchReport], None] | None = None,
        publish: Sink | None = None,
    ):
        self.ledger, self.send, self.record = ledger, send, record
        self.report, self.publish = report, publish

    def run(self, summaries: DataFrame, batch_id: int, batch_seconds: float) -> bool:
        """Runs one batch; False when it had been committed before."""
        ledger = self.ledger
        if ledger.is_committed(batch_id):
            return False
        policy, models = ledger.policy, ledger.models()
        arrived = Observation()
        seen = summaries.observe(arrived, F.count(F.lit(1)).alias("sessions"))
        taken = step(seen, ledger.state(batch_id, summaries), models, policy)
        steps, counts = ledger.write_steps(taken, batch_id)
        n_judged = sum(counts.judged.values())
        when = F.lit(float(batch_seconds))
        if self.send:
            suggested = outputs.suggestions(steps, when, policy)
            self.send(outputs.suggestion_messages(suggested) if counts.suggested else None, batch_id)
        if self.record:
            self.record(outputs.metrics(steps, when, policy) if n_judged else None, batch_id)
        if self.publish:
            some = counts.suggested or n_judged
            self.publish(outbox.rows_of(steps, when, policy) if some else None, batch_id)
        learned = None
        if n_judged:
            examples = outputs.training_examples(steps)
            if policy.step_per_example:
                learned = local_sgd.update(
                    examples, models, policy, ledger.scratch(batch_id), counts.judged
                )
            else:
                learned = training.update(examples, models, policy)
        ledger.commit(batch_id, learned)
        if self.report:
            n_sessions = observed(arrived).get("sessions", 0)
            self.report(BatchReport(batch_id, n_sessions, counts.suggested, n_judged))
        return True


def any_rows(rows: DataFrame) -> DataFrame | None:
    """The rows for a sink, None if there are none."""
    return rows if rows.limit(1).count() else None


def table_sink(table: str, fmt: str = "parquet") -> Sink:
    """Writes each batch to its partition of a registered table and replaces it on a retry; nothing
    is written for a batch without rows."""

    def write(rows: DataFrame | None, batch_id: int) -> None:
        spark = rows.sparkSession if rows is not None else SparkSession.active()
        if rows is None:
            if spark.catalog.tableExists(table):
                spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (batch_id={int(batch_id)})")
            return
        rows = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        if not spark.catalog.tableExists(table):
            rows.limit(0).write.format(fmt).partitionBy("batch_id").saveAsTable(table)
        columns = spark.table(table).columns
        writer = rows.select(*columns).write.mode("overwrite").format(fmt)
        writer.option("partitionOverwriteMode", "dynamic").insertInto(table)

    return write


def file_sink(folder: str, fmt: str = "parquet") -> Sink:
    """Writes each batch to a folder of its own and replaces it on a retry; a batch without rows
    has none."""

    def write(rows: DataFrame | None, batch_id: int) -> None:
        path = f"{folder.rstrip('/')}/batch_id={batch_id}"
        if rows is not None:
            rows.drop("batch_id").write.mode("overwrite").format(fmt).save(path)
        else:
            remove(SparkSession.active(), path)  # what an earlier try may have left

    return write


def message_sink(fmt: str, options: dict[str, str]) -> Sink:
    """Sends message bodies to a message service; a log source calls the body ``value``."""

    def write(rows: DataFrame | None, batch_id: int) -> None:
        if rows is None:
            return
        named = rows.withColumnRenamed("body", "value") if fmt == "kafka" else rows
        named.write.format(fmt).options(**options).save()

    return write


def replay_batches(
    spark: SparkSession,
    rows: DataFrame,
    folder: str,
    batch_seconds: Callable[[int], float],
    policy: Policy = Policy(),
) -> Ledger:
    """Runs all batches of bounded behaviour rows in order.

    Session-batches do not depend on the models, so they are worked out for all batches at once
    and written by batch; the loop then reads one batch at a time. Suggestions and performance rows go
    to ``folder/outbox``.
    """
    folder = folder.rstrip("/")
    summaries = session_batch.usable(session_batch.summarize(rows, policy))
    # Clustered by batch and cut by size, so a batch is neither one huge file nor many tiny ones.
    (
        summaries.hint("rebalance", "batch_id")
        .write.mode("overwrite")
        .partitionBy("batch_id")
        .parquet(f"{folder}/summaries")
    )
    landed = spark.read.schema(summaries.schema).parquet(f"{folder}/summaries")
    landed = landed.select(*summaries.columns)
    batch_ids = sorted(r["batch_id"] for r in landed.select("batch_id").distinct().collect())
    ledger = Ledger(spark, f"{folder}/ledger", policy)
    loop = LearningLoop(ledger, publish=outbox.publisher(spark, f"{folder}/outbox"))
    for batch_id in batch_ids:
        batch = landed.where(F.col("batch_id") == batch_id)
        loop.run(batch, batch_id, batch_seconds(batch_id))
    return ledger
