"""Compresses vectors to codes: one byte per part, an index into that part's codebook.

Vectors are made whole numbers (``floor(4096 * x)``) and cut into equal parts; each part position has a
codebook of up to 16 entries, which starts as the parts of the smallest ids and is refined by rounds of
Lloyd's method in exact whole-number arithmetic.

**Member-resident rounds.** The parts live in blocks, a row each: up to ``BLOCK`` parts of one (position,
entry, salt), with their number and their sum. Their owner is the partition of that key. In a round
the owners assign their resident parts anew against the shipped codebooks (a few thousand numbers).
Parts that keep their entry stay in their owner's files: they are written through without a shuffle. Only
parts whose entry changed are gathered into new blocks and go through the shuffle, to the owners of
their new entries. The next entries follow from the sums that the owners keep with their blocks, so
what Spark adds up is one short row per block, and the driver sees one row per entry. Salts bound what
one owner holds, also when an entry attracts all parts: there are as many as ``MEMBERS`` parts per
owner need.

Rounds move fewer and fewer parts; each round's tables are landed in the shared folder, those of the
round before the last are removed. The closing assignment reads the vectors once more, a row at a time,
so the codes need no join.

Defined cases: rows with a null vector, or one with null or not finite components, are dropped. Ids may
repeat or be null: each row gets its own code; rows with equal ids are ordered by their vectors and null
ids come last where the smallest ids are sought. With fewer than 16 kept rows a codebook has as many
entries as there are rows. An empty table, or one without a kept row, gives no rows. Empty vectors have
empty parts: code zeros, error 0. Kept vectors that differ in length, or whose length is no multiple of
the number of parts, are an error, as are components beyond 2^19 (the parts are held in 32 bits, or in
16 where they fit). Other columns than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import landed, remove, task, workspace

SCALE = 4096
N_PARTS, N_ENTRIES, N_ROUNDS = 8, 16, 6
# Parts per block, and about how many parts an owner (position, entry, salt) holds.
BLOCK = 8192
MEMBERS = 1 << 20
# Most distinct labels whose error sums are shipped.
SHIP_LABELS = 100_000
_LIMIT = 2.0**31

VECTORS = "vec_id BIGINT, label STRING, parts BINARY"
RESIDENTS = "position INT, entry INT, salt INT, n BIGINT, total ARRAY<BIGINT>, members BINARY"
CODES = "vec_id BIGINT, label STRING, code STRING, error BIGINT"


def _usable(vector: Column) -> Column:
    def finite(x):
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(vector, finite), F.lit(False))


def _whole(width: int, n_parts: int):
    """Whole numbers of each vector; one Arrow batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            if not (np.diff(lists.offsets.to_numpy()) == width).all() or width % n_parts:
                raise ValueError(f"vectors must all have {width} components, a multiple of {n_parts}")
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            numbers = np.floor(SCALE * flat)
            if (np.abs(numbers) >= _LIMIT).any():
                raise ValueError("components must lie within 2^19")
            rows = numbers.astype("<i4").reshape(batch.num_rows, width)
            parts = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), parts], names=["vec_id", "label", "parts"]
            )

    return run


def _unpacked(cells, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<i4").reshape(len(cells), width).astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (the lowest on ties), and the squared distance.

    Exact: doubles hold all whole numbers that occur while they stay below 2^53, otherwise Python's
    own integers are used.
    """
    if not parts.shape[1]:
        return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * parts.shape[1] < 1 << 52 else object
    p, e = parts.astype(kind), entries.astype(kind)
    square = (p * p).sum(axis=1)
    distance = square[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)
    at = np.argmin(distance, axis=1)
    found = distance[np.arange(len(parts)), at]
    if kind is object and any(x >= 1 << 63 for x in found.tolist()):
        raise ValueError("squared distances must fit a long")
    return at, found.astype(np.int64)


def _packed(members: np.ndarray) -> bytes:
    """In 16 bits where they fit; a reader tells by the length."""
    small = np.abs(members).max(initial=0) < 1 << 15
    return members.astype("<i2" if small else "<i4").tobytes()


def _members(cell: bytes, n: int, size: int) -> np.ndarray:
    kind = "<i2" if len(cell) == 2 * n * size else "<i4"
    return np.frombuffer(cell, kind).reshape(n, size).astype(np.int64)


class _Blocks:
    """Collects parts by position and entry and gives full blocks, dealt over the salts in turn.

    Tasks begin with different salts, so those with a block or two each spread them as well."""

    def __init__(self, salts: int, mark: int | None = None):
        task = TaskContext.get()
        self.salts, self.mark = salts, mark
        self.first = task.partitionId() if task else 0
        self.turns: dict[tuple[int, int], int] = {}
        self.open: dict[tuple[int, int], list[np.ndarray]] = {}
        self.held: dict[tuple[int, int], int] = {}
        self.done: list[tuple] = []

    def add(self, position: int, entries: np.ndarray, members: np.ndarray) -> None:
        order = np.argsort(entries, kind="stable")
        found, starts = np.unique(entries[order], return_index=True)
        for entry, part in zip(found.tolist(), np.split(members[order], starts[1:])):
            key = (position, entry)
            self.open.setdefault(key, []).append(part)
            self.held[key] = self.held.get(key, 0) + len(part)
            if self.held[key] >= BLOCK:
                self.close(key)

    def close(self, key: tuple[int, int]) -> None:
        members = np.concatenate(self.open.pop(key))
        self.held.pop(key)
        for start in range(0, len(members), BLOCK):
            part = members[start : start + BLOCK]
            turn = self.turns.get(key, self.first)
            self.done.append(block(*key, turn % self.salts, part, self.mark))
            self.turns[key] = turn + 1

    def taken(self) -> list[tuple]:
        out, self.done = self.done, []
        return out

    def rest(self) -> list[tuple]:
        for key in list(self.open):
            self.close(key)
        return self.taken()


def block(position: int, entry: int, salt: int, members: np.ndarray, mark: int | None = None) -> tuple:
    row = (position, entry, salt, len(members), members.sum(axis=0).tolist(), _packed(members))
    return row if mark is None else (*row, mark)


_ARROW = [
    ("position", pa.int32()),
    ("entry", pa.int32()),
    ("salt", pa.int32()),
    ("n", pa.int64()),
    ("total", pa.list_(pa.int64())),
    ("members", pa.binary()),
    ("moves", pa.int32()),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = _ARROW[: len(rows[0])]
    columns = [pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def _first_owners(books: np.ndarray, width: int, salts: int):
    """Parts of the vectors in blocks, by nearest entry."""
    n_parts, _, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(salts)
        for batch in batches:
            rows = _unpacked(batch.column("parts").to_pylist(), width)
            for position in range(n_parts):
                part = rows[:, position * size : (position + 1) * size]
                blocks.add(position, nearest(part, books[position])[0], part)
            if blocks.done:
                yield _batch(blocks.taken())
        if rest := blocks.rest():
            yield _batch(rest)

    return run


def _reassigned(books: np.ndarray, salts: int):
    """One round of the owners: parts that stay (``moves`` 0), and new blocks of those that leave."""
    size = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaving = _Blocks(salts, mark=1)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                members = _members(r["members"], r["n"], size)
                entries, _ = nearest(members, books[r["position"]])
                stays = entries == r["entry"]
                if stays.any():
                    rows.append(block(r["position"], r["entry"], r["salt"], members[stays], mark=0))
                if not stays.all():
                    leaving.add(r["position"], entries[~stays], members[~stays])
            rows += leaving.taken()
            if rows:
                yield _batch(rows)
        if rest := leaving.rest():
            yield _batch(rest)

    return run


def _to_owners(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("position", "entry", "salt")


def updated(residents: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next entries: the owners' sums over their members' number, rounded down; unused ones stay.

    The driver gets one row per position and entry.
    """
    size = books.shape[2]
    sums = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(size)]
    out = books.copy()
    for r in residents.groupBy("position", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["position"], r["entry"]] = [int(r[f"t{i}"]) // r["n"] for i in range(size)]
    return out


def fit(
    vectors: DataFrame,
    first: np.ndarray,
    width: int,
    folder: str,
    n_rounds: int = N_ROUNDS,
    members_per_owner: int = MEMBERS,
    n_rows: int | None = None,
) -> np.ndarray:
    """Codebooks (position, entry, component) after all rounds. ``vectors`` are landed rows with
    ``parts``; ``first`` are the codebooks to begin with."""
    spark, books = vectors.sparkSession, first
    n_rows = vectors.count() if n_rows is None else n_rows
    salts = max(1, -(-n_rows // members_per_owner))
    begun = vectors.select("parts").mapInArrow(task(__name__, _first_owners(books, width, salts)), RESIDENTS)
    residents = landed(_to_owners(begun), f"{folder}/round-1")
    books = updated(residents, books)
    for number in range(2, n_rounds + 1):
        path = f"{folder}/round-{number}"
        marked = residents.mapInArrow(task(__name__, _reassigned(books, salts)), RESIDENTS + ", moves INT")
        marked.write.mode("overwrite").partitionBy("moves").parquet(f"{path}/owners")
        seen = spark.read.schema(RESIDENTS + ", moves INT").parquet(f"{path}/owners")
        stayed = seen.where("moves = 0").drop("moves")
        arrived = landed(_to_owners(seen.where("moves = 1").drop("moves")), f"{path}/arrived")
        residents = stayed.union(arrived)
        books = updated(residents, books)
        remove(spark, f"{folder}/round-{number - 1}")
    remove(spark, f"{folder}/round-{n_rounds}")
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _coded(books: np.ndarray, width: int):
    n_parts, _, size = books.shape
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _unpacked(batch.column("parts").to_pylist(), width)
            codes = np.empty((len(rows), n_parts), np.int64)
            error = np.zeros(len(rows), np.int64)
            for position in range(n_parts):
                part = rows[:, position * size : (position + 1) * size]
                codes[:, position], far = nearest(part, books[position])
                error += far
            spelled = ["".join(r) for r in hexes[codes].tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(spelled, pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def compress(
    table: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    n_parts: int = N_PARTS,
    n_entries: int = N_ENTRIES,
    n_rounds: int = N_ROUNDS,
    members_per_owner: int = MEMBERS,
    ship_labels: int = SHIP_LABELS,
    folder: str | None = None,
) -> DataFrame:
    """``vec_id``, ``label`` (as text), ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of
    every kept row."""
    if n_entries > 256:
        raise ValueError("an entry's index takes one byte")
    spark = table.sparkSession
    folder = workspace(spark, "codes", folder)
    kept = table.select(
        F.col(f"`{id}`").cast("bigint").alias("vec_id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    ).where(_usable(F.col("vector")))
    extent = kept.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not extent["n"]:
        return spark.createDataFrame([], CODES + ", label_error BIGINT, codebooks_sha256 STRING")
    width = extent["width"]
    vectors = landed(kept.mapInArrow(task(__name__, _whole(width, n_parts)), VECTORS), f"{folder}/vectors")
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(n_entries).collect()
    first = np.stack([np.frombuffer(r["parts"], "<i4").astype(np.int64) for r in seeds])
    books = first.reshape(len(seeds), n_parts, width // n_parts).transpose(1, 0, 2)
    books = fit(vectors, books, width, folder, n_rounds, members_per_owner, extent["n"])
    codes = landed(vectors.mapInArrow(task(__name__, _coded(books, width)), CODES), f"{folder}/codes")
    totals = landed(codes.groupBy("label").agg(F.sum("error").alias("label_error")), f"{folder}/labels")
    if totals.count() <= ship_labels:
        totals = F.broadcast(totals)
    whole = totals.withColumnRenamed("label", "of")
    return codes.join(whole, F.col("label").eqNullSafe(F.col("of"))).select(
        *codes.columns, "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
