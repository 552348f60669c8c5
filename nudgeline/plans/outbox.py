"""Suggestions and performance rows of a batch, published together or not at all.

Both kinds are written in one job by a Spark data source of its own. Tasks put their rows into a folder
of the attempt, one part of it per kind; when all have succeeded, one small file names the attempt as
the batch's. A reader takes the attempts that are named, so both kinds appear at the same moment, and
a crash at any point before leaves neither to be seen. A batch that is published again replaces what it
had published before; what a failed or replaced attempt wrote is removed.

The folder may lie anywhere that Arrow's file systems reach from the executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import file_system
from ..settings import Policy
from . import outputs

KINDS = ("suggestions", "metrics")
ROWS = (
    "kind STRING, batch_id BIGINT, at DOUBLE, session_id STRING, component STRING, "
    "injection_id STRING, device STRING, model_confidence DOUBLE, reward_received DOUBLE"
)
_COMMITS = "batch_id BIGINT, attempt STRING"


@dataclass
class Written(WriterCommitMessage):
    """The files of one task."""

    files: list[str]


class OutboxWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch_id: int):
        self.path, self.batch_id, self.attempt = path.rstrip("/"), batch_id, uuid.uuid4().hex

    def _folder(self, kind: str, attempt: str | None = None) -> str:
        return f"{self.path}/{kind}/batch_id={self.batch_id}/attempt={attempt or self.attempt}"

    def write(self, iterator: Iterator) -> Written:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.parquet"
        writers, files = {}, []
        for batch in iterator:
            for kind in KINDS:
                rows = batch.filter(pc.equal(batch.column("kind"), kind)).drop_columns(["kind", "batch_id"])
                if not rows.num_rows:
                    continue
                if kind not in writers:
                    system, folder = file_system(self._folder(kind))
                    system.create_dir(folder, recursive=True)
                    files.append(f"{folder}/{name}")
                    writers[kind] = pq.ParquetWriter(files[-1], rows.schema, filesystem=system)
                writers[kind].write_batch(rows)
        for writer in writers.values():
            writer.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        # Tasks that ran twice leave files that none of the messages names.
        named = {f for m in messages if m for f in m.files}
        for kind in KINDS:
            _, folder = file_system(self._folder(kind))
            for file in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if file.path not in named:
                    system.delete_file(file.path)
        place = f"{root}/commits/batch_id={self.batch_id}.json"
        before = self._published(system, place)
        system.create_dir(f"{root}/commits", recursive=True)
        draft = f"{root}/commits/_{self.attempt}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"batch_id": self.batch_id, "attempt": self.attempt}).encode())
        system.move(draft, place)
        if before:
            self._remove(system, before)

    @staticmethod
    def _published(system, place: str) -> str | None:
        try:
            with system.open_input_stream(place) as known:
                return json.loads(known.read())["attempt"]
        except FileNotFoundError:
            return None

    def _remove(self, system, attempt: str) -> None:
        for kind in KINDS:
            _, folder = file_system(self._folder(kind, attempt))
            try:
                system.delete_dir(folder)
            except FileNotFoundError:
                pass  # no rows of this kind

    def abort(self, messages: list) -> None:
        system, _ = file_system(self.path)
        self._remove(system, self.attempt)


class OutboxSource(DataSource):
    """``df.write.format("outbox").option("path", ...).option("batch_id", ...)``, rows as in ``ROWS``."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> OutboxWriter:
        return OutboxWriter(self.options["path"], int(self.options["batch_id"]))


def rows_of(steps: DataFrame, when: Column, policy: Policy = Policy()) -> DataFrame:
    """Both outputs of some steps, told apart by ``kind``; one pass."""
    suggests = F.col("kind") == "suggest"
    return steps.select(
        F.when(suggests, KINDS[0]).otherwise(KINDS[1]).alias("kind"),
        "batch_id",
        when.alias("at"),
        "session_id",
        outputs.arm_name(F.col("arm_idx"), policy).alias("component"),
        "injection_id",
        "device",
        F.col("score").alias("model_confidence"),
        F.col("reward").alias("reward_received"),
    )


def publisher(spark: SparkSession, path: str, source: type[DataSource] = OutboxSource):
    """A function that publishes a batch's rows (``rows_of``), or, given None, that it has none."""
    spark.dataSource.register(source)

    def publish(rows: DataFrame | None, batch_id: int) -> None:
        if rows is None:
            rows = spark.createDataFrame([], ROWS)
        writer = rows.write.format(source.name()).option("path", path).option("batch_id", batch_id)
        writer.mode("append").save()

    return publish


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The published suggestions or metrics, in the shape that the other sinks give them."""
    path = path.rstrip("/")
    columns = [c.split(" ") for c in ROWS.split(", ")][2:]
    schema = ", ".join(f"{name} {type_}" for name, type_ in columns) + ", batch_id BIGINT, attempt STRING"
    try:
        commits = spark.read.schema(_COMMITS).json(f"{path}/commits/batch_id=*.json")
        rows = spark.read.schema(schema).parquet(f"{path}/{kind}")
        rows = rows.join(commits, ["batch_id", "attempt"], "left_semi")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        rows = spark.createDataFrame([], schema)
    if kind == "suggestions":
        return rows.select("batch_id", "session_id", "component", "injection_id", F.col("at").alias("timestamp"))
    return rows.select(
        "batch_id",
        F.col("at").alias("time"),
        "session_id",
        "device",
        F.col("component").alias("action_chosen"),
        "model_confidence",
        "reward_received",
    )
