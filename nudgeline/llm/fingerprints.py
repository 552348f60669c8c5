"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines). Its fingerprint is a sum over them, so it does
not depend on their order, and a paragraph is inserted or deleted by adding or subtracting its part
without reading the rest. It has two halves, both sums of wide vectors modulo a power of two:

* ``exact``: 32 lanes modulo 2^32, hashed from each paragraph's bytes; equal multisets are equal
  here, different ones differ but for chance;
* ``likeness``: 128 lanes modulo 2^32, where every phrase of a paragraph (a run without closing
  marks, of 96 bytes at most) adds +1 or -1 to every lane. The angle between two such vectors tells
  how many phrases two documents share: 1 for equal, near 0 for unrelated ones. Lanes are read as
  signed numbers; a text of 2 GB, the most a row can hold, has fewer than 2^31 phrases.

``edited`` is a worked use: every text loses its last third to the beginning of its neighbour in
descending order of ids, and its new fingerprint is the old one minus the paragraphs that went plus
those that came. Neighbours meet by a range split over the ids: texts travel once, and the one row
at the edge of each range also goes to the range before it.

Defined cases: a null text is empty; an empty text is one empty paragraph without phrases; rows with
equal ids follow each other ordered by text; rows without an id come last; a single row is its own
neighbour; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, task
from .hashing import mixed
from .token_files import NO_ID

EXACT_LANES, LIKENESS_LANES = 32, 128
_PHRASE = re.compile(rb"[^.,;:!?|\n]{1,96}")
_LANE = (np.arange(1, EXACT_LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


class Fingerprint:
    """The two sums; ``+`` and ``-`` work on whole multisets of paragraphs."""

    __slots__ = ("exact", "likeness")

    def __init__(self, exact: np.ndarray, likeness: np.ndarray):
        self.exact, self.likeness = exact, likeness

    @classmethod
    def of(cls, paragraphs: list[bytes]) -> Fingerprint:
        exact = np.zeros(EXACT_LANES, np.uint32)
        likeness = np.zeros(LIKENESS_LANES, np.int64)
        for start in range(0, len(paragraphs), 4096):
            part = paragraphs[start : start + 4096]
            digests = b"".join(map(xxhash.xxh3_128_digest, part))
            halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
            lanes = mixed(mixed(halves[:, :1] + _LANE) ^ halves[:, 1:])
            exact += (lanes >> np.uint64(32)).astype(np.uint32).sum(axis=0, dtype=np.uint32)
            phrases = [p for p in _PHRASE.findall(b"\n".join(part)) if not p.isspace()]
            if phrases:
                digests = b"".join([xxhash.xxh3_128_digest(p.strip()) for p in phrases])
                signs = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16), axis=1)
                likeness += 2 * signs.sum(axis=0, dtype=np.int64) - len(phrases)
        return cls(exact, likeness.astype(np.uint32))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.likeness + other.likeness)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.likeness - other.likeness)

    def __str__(self) -> str:
        data = self.exact.astype("<u4").tobytes() + self.likeness.astype("<u4").tobytes()
        return base64.b64encode(data).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        data = base64.b64decode(text)
        cut = 4 * EXACT_LANES
        return cls(np.frombuffer(data[:cut], "<u4"), np.frombuffer(data[cut:], "<u4"))

    def same(self, other: Fingerprint) -> bool:
        return bool((self.exact == other.exact).all())

    def like(self, other: Fingerprint) -> float:
        """0 to 1; the lanes are read as signed numbers."""
        if self.same(other):
            return 1.0
        a, b = (x.likeness.astype(np.int32).astype(np.float64) for x in (self, other))
        size = math.sqrt(float(a @ a) * float(b @ b))
        return round(min(1.0, max(0.0, float(a @ b) / size)), 6) if size else 0.0


def paragraphs(text: str) -> list[bytes]:
    return text.encode().split(b"\n")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "body"):
            made = [
                str(Fingerprint.of(paragraphs(t or ""))) for t in batch.column("body").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(made, pa.string())],
                names=["doc_id", "fingerprint"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInArrow(task(__name__, run), "doc_id BIGINT, fingerprint STRING")


# --- neighbours in descending order of ids ----------------------------------------------------------


def _ranges(ids: DataFrame, n_parts: int) -> tuple[np.ndarray, dict[int, int]]:
    """Where the ranges begin, and for the first id of each range the range before it."""
    points = [i / n_parts for i in range(1, n_parts)]
    splits = []
    if points:
        found = ids.agg(F.percentile_approx("id", points, 10 * n_parts).alias("p")).first()["p"]
        splits = sorted(set(found or []))
    edges = np.array(splits, np.int64)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column("id").to_numpy()
            part = _part(value, edges)
            for p in np.unique(part):
                top = int(value[part == p].max())
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([int(p)], pa.int32()), "top": pa.array([top], pa.int64())}
                )

    rows = ids.mapInArrow(task(__name__, tops), "part INT, top BIGINT").groupBy("part").agg(F.max("top").alias("top"))
    first = {r["part"]: r["top"] for r in rows.collect()}  # one row per range
    filled = sorted(first)
    return edges, {first[p]: filled[i - 1] for i, p in enumerate(filled)}


def _part(value: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The highest ids are in range 0."""
    return (len(edges) - np.searchsorted(edges, value, side="left")).astype(np.int32)


def neighbours(docs: DataFrame, text: str, n_parts: int) -> DataFrame:
    """Rows by range, each in descending order of ids, followed by the row that comes next."""
    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), body)
    edges, also = _ranges(rows.select("id"), n_parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "body", "part", "turn"]
        for batch in batches:
            value = batch.column("id").to_numpy()
            part, turn = _part(value, edges), np.zeros(len(value), np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(part), pa.array(turn)], names=names
            )
            for i in np.flatnonzero(np.isin(value, list(also))):
                to = also[int(value[i])]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, 1).columns, pa.array([to], pa.int32()), pa.array([1], pa.int32())],
                    names=names,
                )

    sent = rows.mapInArrow(task(__name__, send), "id BIGINT, body STRING, part INT, turn INT")
    placed = sent.repartitionById(len(edges) + 1, F.col("part"))
    return placed.sortWithinPartitions("part", "turn", F.col("id").desc(), "body")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int, int]]:
    for batch in batches_by_bytes(batches, "body"):
        yield from zip(*(batch.column(c).to_pylist() for c in ("id", "body", "part", "turn")))


_EDITED = (
    "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, "
    "edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE"
)


def _edit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in range(7)]
    kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)
    names = [c.split()[0] for c in _EDITED.split(", ")]

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
        for column in out:
            column.clear()
        return made

    held = None
    for row in _rows(batches):
        row = (*row, Fingerprint.of(paragraphs(row[1])))
        if held is not None and held[3] == 0 and held[2] == row[2]:
            (doc_id, body, _, _, own), (_, after, _, _, following) = held, row
            cut = len(body) // 3
            head = body[: len(body) - cut]
            text = head + after[:cut]
            same = head.count("\n")  # paragraphs before this one stay as they are
            new = paragraphs(text)
            edited = own - Fingerprint.of(paragraphs(body)[same:]) + Fingerprint.of(new[same:])
            values = (
                None if doc_id == NO_ID else doc_id,
                len(body),
                hashlib.sha256(text.encode()).hexdigest(),
                str(own),
                str(edited),
                own.like(edited),
                own.like(following),
            )
            for column, value in zip(out, values):
                column.append(value)
            if len(out[0]) >= 1000:
                yield flush()
        held = row
    if out[0]:
        yield flush()


def edited(docs: DataFrame, text: str = "text", n_parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness."""
    n_parts = n_parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return neighbours(docs, text, n_parts).mapInArrow(task(__name__, _edit_all), _EDITED)
