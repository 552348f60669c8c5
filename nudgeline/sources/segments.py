"""A message stream over a folder of log segments, with partitions, offsets and an admission limit.

The folder has a subfolder ``partition=<n>`` per partition and in it segments ``<first offset>.log``, one
message per line; a message's offset is its line's number counted from the segment's first. Segments are
only added to. Rows come as ``partition``, ``offset`` and binary ``body``, the columns of a log service, so
``read_message_stream`` gives them arrival numbers.

The offsets of a micro-batch are the next one to read of every partition. At most ``limit`` messages are
admitted per partition and micro-batch; a stream that is started again goes on from its checkpoint. As
the engine does not say where that is when it asks how far it may go, the end of every planned
micro-batch is noted in the file ``progress``, which belongs to the checkpoint: a micro-batch that was
noted and did not finish is planned again before the question comes up.

The driver lists the folder and counts the lines of each partition's newest segment; reading is done in
tasks, one per partition and ``rows_per_task`` messages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..session import file_system

SCHEMA = "partition INT, offset BIGINT, body BINARY"
FORMAT = "segments"
_ARROW = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("body", pa.binary())])
_BLOCK = 4096


def segments(path: str) -> dict[int, list[tuple[int, str]]]:
    """First offset and path of every partition's segments, in order."""
    from pyarrow import fs

    system, root = file_system(path)
    found: dict[int, list[tuple[int, str]]] = {}
    for file in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if file.extension != "log":
            continue
        folder = file.path.rsplit("/", 2)[-2]
        number = int(folder.removeprefix("partition="))
        found.setdefault(number, []).append((int(file.base_name.removesuffix(".log")), file.path))
    return {number: sorted(own) for number, own in sorted(found.items())}


def _lines(system, path: str) -> Iterator[bytes]:
    """Whole lines; what follows the last line end is still being written."""
    rest = b""
    with system.open_input_stream(path) as stream:
        while block := stream.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            yield from whole


class Stretch(InputPartition):
    """Messages of one partition: offsets from ``start`` up to ``end``."""

    def __init__(self, number: int, start: int, end: int):
        self.number, self.start, self.end = number, start, end


class SegmentReader(DataSourceStreamReader):
    def __init__(self, path: str, limit: int | None, progress: str | None, rows_per_task: int):
        if limit is not None and progress is None:
            raise ValueError("a limit needs a progress file")
        self.path, self.limit, self.progress = path, limit, progress
        self.rows_per_task = rows_per_task
        self.planned: dict | None = None  # where the newest micro-batch ends

    def initialOffset(self) -> dict:
        self.planned = {}  # asked for by a stream without a checkpoint only
        return {}

    def latestOffset(self) -> dict:
        system, _ = file_system(self.path)
        ends = {}
        for number, own in segments(self.path).items():
            first, path = own[-1]
            ends[str(number)] = first + sum(1 for _ in _lines(system, path))
        if self.limit is None:
            return ends
        start = self._noted() if self.planned is None else self.planned
        return {n: max(start.get(n, 0), min(end, start.get(n, 0) + self.limit)) for n, end in ends.items()}

    def _noted(self) -> dict:
        system, place = file_system(self.progress)
        try:
            with system.open_input_stream(place) as known:
                return json.loads(known.read())
        except FileNotFoundError:
            return {}

    def _note(self, end: dict) -> None:
        system, place = file_system(self.progress)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(place + ".draft") as out:
            out.write(json.dumps(end).encode())
        system.move(place + ".draft", place)

    def partitions(self, start: dict, end: dict) -> Sequence[Stretch]:
        self.planned = end
        if self.progress is not None:
            self._note(end)
        out = []
        for number, stop in end.items():
            at = start.get(number, 0)
            while at < stop:
                upto = min(stop, at + self.rows_per_task)
                out.append(Stretch(int(number), at, upto))
                at = upto
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows: list[tuple[int, bytes]] = []
        own = segments(self.path)[partition.number]
        for place, (first, path) in enumerate(own):
            beyond = own[place + 1][0] if place + 1 < len(own) else partition.end
            if beyond <= partition.start or first >= partition.end:
                continue
            for offset, line in enumerate(_lines(system, path), first):
                if partition.start <= offset < partition.end:
                    rows.append((offset, line))
                if len(rows) == _BLOCK:
                    yield _batch(partition.number, rows)
                    rows = []
        if rows:
            yield _batch(partition.number, rows)

    def commit(self, end: dict) -> None:
        pass


def _batch(number: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    offsets, bodies = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * len(rows), pa.int32()), pa.array(offsets, pa.int64()), pa.array(bodies, pa.binary())],
        schema=_ARROW,
    )


class SegmentSource(DataSource):
    """Options: ``path``; ``limit``, messages per partition and micro-batch, and then ``progress``;
    ``rows_per_task``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> SegmentReader:
        limit = self.options.get("limit")
        per_task = int(self.options.get("rows_per_task", 1_000_000))
        progress = self.options.get("progress")
        return SegmentReader(self.options["path"], int(limit) if limit else None, progress, per_task)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; then ``read_message_stream(spark, FORMAT, options)``."""
    spark.dataSource.register(SegmentSource)
