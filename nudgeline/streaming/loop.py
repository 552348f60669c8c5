"""The live job: messages in, suggestions out, learning batch by batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import session_batch
from ..plans.learned_loop import BatchReport, LearningLoop, Sink, any_rows, file_sink
from ..plans.ledger import Ledger
from ..settings import Policy
from ..sources import messages


def _decoded(batch: DataFrame, batch_id: int) -> DataFrame:
    """The batch's messages, decoded once; kept, since several branches read them. Lost parts
    are worked out again from the source."""
    numbered = messages.with_arrival(batch).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    return messages.decode(numbered).persist(StorageLevel.MEMORY_AND_DISK)


def start(
    stream: DataFrame,
    folder: str,
    policy: Policy = Policy(),
    send: Sink | None = None,
    record: Sink | None = None,
    clock: Callable[[int], float] | None = None,
    report: Callable[[BatchReport], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts the learning loop on a message stream (``read_message_stream``).

    ``folder`` holds the ledger, the quarantine and the stream's checkpoint. Sinks default to
    files next to them. A batch that fails anywhere is tried again as a whole.
    """
    folder = folder.rstrip("/")
    send = send or file_sink(f"{folder}/suggestions", "json")
    record = record or file_sink(f"{folder}/metrics")
    put_aside = file_sink(f"{folder}/quarantine")
    ledger = Ledger(stream.sparkSession, f"{folder}/ledger", policy)
    loop = LearningLoop(ledger, send, record, report)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if ledger.is_committed(batch_id):
            return
        seconds = clock(batch_id) if clock else time.time()
        decoded = _decoded(batch, batch_id)
        try:
            put_aside(any_rows(messages.quarantine(decoded)), batch_id)
            rows = messages.behaviour(decoded)
            # One row per session; read for the state look-up and for the join with it.
            summaries = session_batch.usable(session_batch.summarize(rows, policy))
            summaries.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                loop.run(summaries, batch_id, seconds)
            finally:
                summaries.unpersist()
        finally:
            decoded.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option(
        "checkpointLocation", f"{folder}/checkpoint"
    )
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def start_summaries(
    stream: DataFrame, folder: str, policy: Policy = Policy(), trigger: dict | None = None
) -> StreamingQuery:
    """Only the first half: session-batches per micro-batch, written to ``folder/summaries``.

    This is the input of ``live.start``. A session's rows are already reduced to one here.
    """
    folder = folder.rstrip("/")
    write = file_sink(f"{folder}/summaries")
    put_aside = file_sink(f"{folder}/quarantine")

    def handle(batch: DataFrame, batch_id: int) -> None:
        decoded = _decoded(batch, batch_id)
        try:
            put_aside(any_rows(messages.quarantine(decoded)), batch_id)
            rows = messages.behaviour(decoded)
            write(any_rows(session_batch.usable(session_batch.summarize(rows, policy))), batch_id)
        finally:
            decoded.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option(
        "checkpointLocation", f"{folder}/summaries_checkpoint"
    )
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
