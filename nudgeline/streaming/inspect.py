"""Looking at raw messages as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import observed
from ..sources.messages import raw_view, with_arrival

SAMPLE_ROWS = 10


def print_sample(batch_id: int, count: int, rows: list[Row]) -> None:
    print(f"batch {batch_id}: {count} messages")
    for row in rows:
        print(row["properties"], row["body_str"])


def start(
    stream: DataFrame,
    checkpoint: str,
    show: Callable[[int, int, list[Row]], None] = print_sample,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Shows the size and the first rows of each micro-batch; never more than those reach the
    driver."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # One pass: the rows are counted on their way into the selection of the first.
        arrived = Observation()
        counted = with_arrival(batch).observe(arrived, F.count(F.lit(1)).alias("n"))
        first = counted.orderBy("arrival").limit(SAMPLE_ROWS).collect()
        show(batch_id, observed(arrived).get("n", 0), first)

    view = raw_view(stream)
    writer = view.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
