"""Token ids in seekable zstandard files: one independent frame per document, a checksum for each.

Layout of a file, all numbers little-endian:

* one zstandard frame per document, holding its ids as 16-bit numbers;
* a skippable frame with the document ids as signed 64-bit numbers;
* a skippable frame with the seek table: per frame its packed size, its plain size and the low 32
  bits of the XXH64 of the plain bytes; then the number of frames, a flag byte and a magic number.

Any zstandard tool can unpack such a file; a reader that wants a few documents reads the end of
the file and then only their frames. Files follow each other in the order of document ids, a task
writes one file and gives it its name only when it is complete, so a lost or repeated task leaves
no torn file behind.

Defined cases: a null or empty text holds the end id alone; rows with equal ids stand next to each
other, ordered by text; rows without an id come first (marked by the lowest 64-bit number); an
empty table yields no rows; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_bytes, landed, task, workspace
from .word_tokens import encoder

SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
NO_ID = -(1 << 63)
FILE_BYTES, TASK_BYTES = 256 << 20, 8 << 20
_FOOTER = struct.Struct("<IBI")

_INDEX = "part INT, file STRING, n_docs BIGINT, n_ids BIGINT"
_READ = "doc_id BIGINT, part INT, frame INT, first BIGINT, ids BINARY"


class CorruptFrame(Exception):
    """The file's bytes do not match its seek table."""


def _open(path: str):
    return filesystems.FileSystem.from_uri(path)


class FrameWriter:
    """Appends documents to one file; ``close`` writes the tables and names the file."""

    def __init__(self, path: str, attempt: str, level: int = 3):
        self.fs, self.path = _open(path)
        self.draft = f"{self.path}.{attempt}"
        parent = self.path.rpartition("/")[0]
        self.fs.create_dir(parent, recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        self.packer = zstandard.ZstdCompressor(level=level)
        # 20 bytes a document.
        self.ids, self.entries = array("q"), array("I")

    def add(self, doc_id: int | None, plain: bytes) -> None:
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        check = xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF
        self.entries.extend((len(packed), len(plain), check))

    def close(self) -> None:
        ids = np.asarray(self.ids).astype("<i8").tobytes()
        table = np.asarray(self.entries).astype("<u4").tobytes()
        table += _FOOTER.pack(len(self.ids), HAS_CHECKSUMS, SEEK_MAGIC)
        for magic, body in ((SKIPPABLE_IDS, ids), (SKIPPABLE_SEEK, table)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)
        self.out.close()
        if self.fs.get_file_info(self.path).type != filesystems.FileType.NotFound:
            self.fs.delete_file(self.path)  # left by an earlier attempt of the same task
        self.fs.move(self.draft, self.path)


class FrameReader:
    """Reads the tables at the end, then any frames by number."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        n, flags, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise CorruptFrame(f"{path}: no seek table")
        start = size - _FOOTER.size - 12 * n
        self.entries = np.frombuffer(self._at(start, 12 * n), "<u4").reshape(n, 3)
        start -= 8 + 8 * n
        self.ids = np.frombuffer(self._at(start, 8 * n), "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, start: int, n: int) -> bytes:
        return self.file.read_at(n, start)

    def __len__(self) -> int:
        return len(self.entries)

    def frames(self, first: int, stop: int) -> Iterator[bytes]:
        """Plain bytes of neighbouring frames, fetched in one read."""
        base = int(self.starts[first])
        data = memoryview(self._at(base, int(self.starts[stop]) - base))
        for i in range(first, stop):
            begin = int(self.starts[i]) - base
            _, size, check = (int(x) for x in self.entries[i])
            part = data[begin : begin + int(self.entries[i][0])]
            plain = self.unpacker.decompress(part, max_output_size=size)
            if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
                raise CorruptFrame(f"{self.path}: frame {i}")
            yield plain

    def close(self) -> None:
        self.file.close()


def _writer(folder: str, vocabulary: str | None, end_id: int):
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        path = f"{folder}/part-{part:06d}.zst"
        out, n_ids = None, 0
        for batch in batches_by_bytes(batches, "body"):
            texts = batch.column("body").to_pylist()
            for doc_id, ids in zip(
                batch.column("doc_id").to_pylist(), encoder(vocabulary).encode_all(texts)
            ):
                if out is None:
                    out = FrameWriter(path, f"attempt-{context.taskAttemptId()}")
                out.add(doc_id, ids + end)
                n_ids += len(ids) // 2 + 1
        if out is None:
            return
        out.close()
        row = {"part": [part], "file": [path], "n_docs": [len(out.ids)], "n_ids": [n_ids]}
        schema = pa.schema(
            [("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
        )
        yield pa.RecordBatch.from_pydict(row, schema=schema)

    return run


def write(
    docs: DataFrame,
    folder: str,
    end_id: int,
    text: str = "text",
    vocabulary: str | None = None,
    n_files: int | None = None,
) -> DataFrame:
    """Writes all documents below ``folder``, ascending by doc_id; gives one row per file.

    Without ``n_files`` there is one for every ``FILE_BYTES`` of text, and small input makes as many as
    there are shuffle partitions as long as each gets ``TASK_BYTES``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    if n_files is None:
        total = rows.agg(F.sum(F.octet_length("body").cast("bigint")).alias("b")).first()["b"] or 0
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n_files = max(1, -(-total // FILE_BYTES), min(most, -(-total // TASK_BYTES)))
    by_id = F.col("doc_id").asc_nulls_first()
    ranged = rows.repartitionByRange(n_files, by_id)
    ranged = ranged.sortWithinPartitions(by_id, F.col("body").asc_nulls_first())
    files = ranged.mapInArrow(task(__name__, _writer(f"{folder}/files", vocabulary, end_id)), _INDEX)
    return landed(files, f"{folder}/index")


def read(files: DataFrame, frames_at_once: int = 256) -> DataFrame:
    """Every document of the files: its ids as bytes and the number of ids of its file before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("part", pa.int32()),
                ("frame", pa.int32()),
                ("first", pa.int64()),
                ("ids", pa.binary()),
            ]
        )
        for batch in batches:
            for part, path in zip(*(batch.column(c).to_pylist() for c in ("part", "file"))):
                reader = FrameReader(path)
                firsts = np.concatenate([[0], np.cumsum(reader.entries[:, 1] // 2, dtype=np.int64)])
                for start in range(0, len(reader), frames_at_once):
                    stop = min(start + frames_at_once, len(reader))
                    ids = reader.ids[start:stop]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids, mask=ids == NO_ID),
                            pa.array([part] * (stop - start), pa.int32()),
                            pa.array(range(start, stop), pa.int32()),
                            pa.array(firsts[start:stop]),
                            pa.array(list(reader.frames(start, stop)), pa.binary()),
                        ],
                        schema=schema,
                    )
                reader.close()

    n = max(1, files.count())
    return files.select("part", "file").repartition(n, "part").mapInArrow(task(__name__, run), _READ)


def read_some(files: DataFrame, part: int, frames: list[int]) -> list[np.ndarray]:
    """Ids of a few documents of one file, unpacking nothing else."""
    path = files.where(F.col("part") == part).first()["file"]
    reader = FrameReader(path)
    found = [np.frombuffer(next(reader.frames(i, i + 1)), "<u2") for i in frames]
    reader.close()
    return found


def file_offsets(files: DataFrame) -> DataFrame:
    """Ids in all files before each; one row per file, so this stays small."""
    counts = sorted((r["part"], r["n_ids"]) for r in files.select("part", "n_ids").collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in counts], dtype=np.int64)])
    rows = [(p, int(s)) for (p, _), s in zip(counts, starts)]
    return files.sparkSession.createDataFrame(rows, "part INT, before BIGINT")


def round_trip(
    docs: DataFrame, end_id: int, vocabulary: str | None = None, folder: str | None = None
) -> DataFrame:
    """Writes all documents, reads the files back, and gives each document's place in them."""
    folder = workspace(docs.sparkSession, "token-files", folder)
    files = write(docs, folder, end_id, vocabulary=vocabulary)
    found = read(files).mapInArrow(
        task(__name__, _digests), "doc_id BIGINT, part INT, frame INT, first BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"
    )
    return found.join(F.broadcast(file_offsets(files)), "part").select(
        "doc_id",
        (F.col("before") + F.col("first")).alias("start"),
        "n_tokens",
        "ids_crc32",
        F.col("part").alias("file_no"),
        "frame",
    )


def crc32_of_ids(ids: bytes) -> int:
    """Checksum of 16-bit ids, taken over their 32-bit form."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [b.as_buffer() for b in batch.column("ids")]
        kept = [batch.column(c) for c in ("doc_id", "part", "frame", "first")]
        yield pa.RecordBatch.from_arrays(
            [
                *kept,
                pa.array([b.size // 2 for b in ids], pa.int64()),
                pa.array([crc32_of_ids(b) for b in ids], pa.int64()),
            ],
            names=["doc_id", "part", "frame", "first", "n_tokens", "ids_crc32"],
        )
