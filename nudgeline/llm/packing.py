"""Best-fit packing of token sequences in bulk-synchronous supersteps.

Pieces (documents, cut only where longer than the capacity) and gaps (open sequences with room left)
are range-sorted by size, and every row gets its rank among the rows of its size. A superstep

1. opens sequences for the largest waiting pieces, if no gap can take them;
2. sweeps the sizes from large to small: each size of pieces takes its successor, the smallest size
   of gaps that still fits, as many rows as both have, then the next; a gap takes pieces of one size
   per superstep, as many as fit;
3. settles by rank which piece gets which gap: the n-th waiting piece of a size goes to the n-th
   gap of the matched size, so no two pieces ever claim the same place;
4. writes the gaps with the room they have left, and starts again until no piece waits.

The sweep itself looks only at how many rows of each size there are, at most ``capacity`` numbers
for either side, whatever the input. Rows stay distributed: gaps are ranked and updated by Spark in
every superstep, pieces are ranked once and joined with their places at the end. Ranks come from a
range sort over size and id, so that one size may hold all rows without one task holding them.
Every superstep's gaps are a table in the shared folder; nothing is collected but counts.

Defined cases: a document without ids has no piece; pieces of full length are sequences of their
own; an empty table gives no rows; repeated rows are pieces of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import batches_by_bytes, landed, task, workspace
from .token_files import crc32_of_ids
from .word_tokens import encoder

CAPACITY = 2048
ROWS_PER_TASK = 200_000
_PIECES = "doc_id BIGINT, piece INT, start BIGINT, length INT, ids_crc32 BIGINT"


def cut(
    docs: DataFrame,
    end_id: int,
    capacity: int = CAPACITY,
    text: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """Pieces of every document: its ids and ``end_id``, cut every ``capacity`` ids."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "body"):
            columns: list[list] = [[], [], [], [], []]
            encoded = encoder(vocabulary).encode_all(batch.column("body").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 2 * capacity)):
                    part = ids[start : start + 2 * capacity]
                    row = (doc_id, piece, start // 2, len(part) // 2, crc32_of_ids(part))
                    for column, value in zip(columns, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInArrow(task(__name__, run), _PIECES)


# --- ranks within a size ---------------------------------------------------------------------------


def _local_ranks(size: str):
    """Rank of a row among the rows of its size in one sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(size).to_numpy()
            index = np.arange(len(sizes))
            begins = np.r_[True, sizes[1:] != sizes[:-1]]
            first = np.maximum.accumulate(np.where(begins, index, 0))
            local = index - first
            if sizes[0] == last:
                local[first == 0] += seen
            last, seen = sizes[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(local)],
                names=[*batch.schema.names, "part", "local"],
            )

    return run


def ranked(rows: DataFrame, size: str, order: list[str], n_rows: int, path: str) -> tuple[DataFrame, dict]:
    """Adds ``rank``, from 0 within each size by ``order``; also gives the rows per size."""
    keys = [size, *order]
    n_tasks = max(1, -(-n_rows // ROWS_PER_TASK))
    ranged = rows.repartitionByRange(n_tasks, *keys).sortWithinPartitions(*keys)
    schema = StructType([*rows.schema.fields]).add("part", IntegerType()).add("local", LongType())
    table = landed(ranged.mapInArrow(task(__name__, _local_ranks(size)), schema), path)
    # A partition holds a range of sizes, so there are at most sizes + partitions of these.
    counts = table.groupBy(size, "part").count().collect()
    before, totals = [], {}
    for value, part, n in sorted(counts):
        before.append((value, part, totals.get(value, 0)))
        totals[value] = totals.get(value, 0) + n
    kind = table.schema[size].dataType.simpleString()
    starts = rows.sparkSession.createDataFrame(before, f"{size} {kind}, part INT, before BIGINT")
    out = table.join(F.broadcast(starts), [size, "part"])
    return out.withColumn("rank", F.col("before") + F.col("local")).drop("part", "local", "before"), totals


# --- the sweep over sizes --------------------------------------------------------------------------


def sweep(waiting: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Matches sizes of pieces with sizes of gaps, large pieces first, smallest fitting gap first.

    Gives (gap size, its gaps passed over, gaps taken, piece size, pieces placed).
    """
    moves = []
    sizes = sorted(gaps)
    taken = dict.fromkeys(sizes, 0)
    top = sizes[-1] if sizes else 0
    for length in sorted(waiting, reverse=True):
        left = waiting[length]
        if not left or length > top:
            continue
        for gap in sizes[int(np.searchsorted(sizes, length)) :]:
            free = gaps[gap] - taken[gap]
            if not free:
                continue
            each = gap // length
            use = min(free, -(-left // each))
            placed = min(left, use * each)
            moves.append((gap, taken[gap], use, length, placed))
            taken[gap] += use
            left -= placed
            if not left:
                break
        sizes = [g for g in sizes if taken[g] < gaps[g]]
        if not sizes:
            break
    return moves


def openings(waiting: dict[int, int], largest_gap: int, capacity: int) -> list[tuple[int, int]]:
    """How many pieces of each size start new sequences: of those that no gap can take, the largest,
    as many as their sum needs at least."""
    stuck = {size: n for size, n in waiting.items() if size > largest_gap and n}
    need = -(-sum(size * n for size, n in stuck.items()) // capacity)
    out = []
    for size in sorted(stuck, reverse=True):
        n = min(need, stuck[size])
        if n:
            out.append((size, n))
            need -= n
    return out


# --- the supersteps --------------------------------------------------------------------------------


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, folder: str | None = None, order: list[str] | None = None
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` have an int column ``length`` of 1 to
    ``capacity``; ``order`` are columns that settle ties."""
    spark = pieces.sparkSession
    folder = workspace(spark, "packing", folder)
    order = order or ["doc_id", "piece"]
    n_rows = pieces.count()
    numbered, waiting = ranked(pieces, "length", order, n_rows, f"{folder}/pieces")
    used = dict.fromkeys(waiting, 0)
    next_id = waiting.pop(capacity, 0)  # full pieces are numbered by their rank
    gaps, n_gaps, step = None, 0, 0
    largest_gap = 0
    slot_paths: list[str] = []
    while any(waiting.values()):
        step += 1
        opened = openings(waiting, largest_gap, capacity)
        if opened:
            rows = []
            for size, n in opened:
                for at in range(0, n, ROWS_PER_TASK):
                    m = min(ROWS_PER_TASK, n - at)
                    rows.append((size, used[size] + at, next_id + at, m))
                used[size] += n
                waiting[size] -= n
                next_id += n
                n_gaps += n
            new = _opened(spark, rows, capacity)
            gaps = new if gaps is None else gaps.unionByName(new, allowMissingColumns=True)
        gaps, counts = ranked(gaps, "gap", ["sequence_id"], n_gaps, f"{folder}/gaps-{step}")
        moves = []
        for gap, skip, use, size, placed in sweep(waiting, {g: n for g, n in counts.items() if g > 0}):
            moves.append((gap, skip, skip + use, size, used[size], placed, gap // size))
            used[size] += placed
            waiting[size] -= placed
        after = _moved(gaps, moves, capacity)
        path = f"{folder}/moved-{step}"
        after = landed(after, path)
        slot_paths.append(path)
        left = after.where(F.col("gap") > 0)
        totals = left.agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("top")).first()
        gaps, n_gaps, largest_gap = left.select("sequence_id", "gap"), totals["n"], totals["top"] or 0
    full = numbered.where(F.col("length") == capacity)
    full = full.withColumn("sequence_id", F.col("rank")).withColumn("offset", F.lit(0).cast("bigint"))
    full = full.drop("rank")
    if not slot_paths:
        return full.select(*pieces.columns, "sequence_id", "offset")
    moved = spark.read.schema(after.schema).parquet(*slot_paths)
    places = _places(moved)
    loose = numbered.where(F.col("length") < capacity)
    placed = loose.join(places, ["length", "rank"]).drop("rank")
    return placed.select(*pieces.columns, "sequence_id", "offset").unionByName(
        full.select(*pieces.columns, "sequence_id", "offset")
    )


def _opened(spark, rows: list[tuple], capacity: int) -> DataFrame:
    """A gap for each new sequence, which holds its first piece already. ``rows`` are runs of
    sequences, short enough for a task each."""
    table = spark.createDataFrame(rows, "seed INT, seed_rank BIGINT, first_id BIGINT, n BIGINT")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i")
    return table.repartition(max(1, len(rows) // 100), "first_id").select("*", each).select(
        (F.col("first_id") + F.col("i")).alias("sequence_id"),
        (F.lit(capacity) - F.col("seed")).cast("int").alias("gap"),
        "seed",
        (F.col("seed_rank") + F.col("i")).alias("seed_rank"),
    )


def _moved(gaps: DataFrame, moves: list[tuple], capacity: int) -> DataFrame:
    """Gaps after a superstep, with what was put into them: ``n`` pieces of ``size`` from rank
    ``first`` on, at ``offset``. At most twice as many moves as sizes are shipped."""
    spark = gaps.sparkSession
    for name, kind in (("seed", "int"), ("seed_rank", "bigint")):
        if name not in gaps.columns:
            gaps = gaps.withColumn(name, F.lit(None).cast(kind))
    table = spark.createDataFrame(
        moves,
        "m_gap INT, from_rank BIGINT, to_rank BIGINT, size INT, base BIGINT, placed BIGINT, each INT",
    )
    match = (
        (F.col("gap") == F.col("m_gap"))
        & (F.col("rank") >= F.col("from_rank"))
        & (F.col("rank") < F.col("to_rank"))
    )
    joined = gaps.join(F.broadcast(table), match, "left")
    skipped = (F.col("rank") - F.col("from_rank")) * F.col("each")
    n = F.least(F.col("each").cast("bigint"), F.col("placed") - skipped)
    n = F.coalesce(n, F.lit(0).cast("bigint"))
    return joined.select(
        "sequence_id",
        (F.col("gap") - n * F.coalesce("size", F.lit(0))).cast("int").alias("gap"),
        "size",
        (F.col("base") + skipped).alias("first"),
        n.alias("n"),
        (F.lit(capacity) - F.col("gap")).cast("bigint").alias("offset"),
        "seed",
        "seed_rank",
    )


def _places(moved: DataFrame) -> DataFrame:
    """One row per placed piece: its size and rank, its sequence and offset."""
    seeds = moved.where(F.col("seed").isNotNull()).select(
        F.col("seed").alias("length"),
        F.col("seed_rank").alias("rank"),
        "sequence_id",
        F.lit(0).cast("bigint").alias("offset"),
    )
    filled = moved.where(F.col("n") > 0).select(
        F.col("size").alias("length"),
        "first",
        "sequence_id",
        "offset",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"),
    )
    filled = filled.select(
        "length",
        (F.col("first") + F.col("i")).alias("rank"),
        "sequence_id",
        (F.col("offset") + F.col("i") * F.col("length")).alias("offset"),
    )
    return seeds.unionByName(filled)


def pack_documents(
    docs: DataFrame,
    end_id: int = 0,
    capacity: int = CAPACITY,
    text: str = "text",
    vocabulary: str | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Cuts and packs all documents."""
    folder = workspace(docs.sparkSession, "packed", folder)
    pieces = landed(cut(docs, end_id, capacity, text, vocabulary), f"{folder}/cut")
    return pack(pieces, capacity, folder)
